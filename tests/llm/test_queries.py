"""The registered queries on the smallest data: against SQL, or that they return whole tables."""

import pytest

from pagesift.llm.queries import ORACLES, QUERIES
from tests.compare import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    found = difference(QUERIES[name](spark, SF), connect(SF), ORACLES[name])
    assert found is None, found


@pytest.mark.parametrize("name", ["op4_token_count", "op6_token_output", "op7_simhash"])
def test_one_row_for_each_document(spark, name):
    out = QUERIES[name](spark, SF)
    assert out.count() == out.select("doc_id").distinct().count() == 200


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n != "pipeline") == list(range(1, 14))
