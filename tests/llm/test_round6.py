"""Findings of round 3's last check on the corpus operators."""

import random

from pagesift.llm import line_dedup, token_output

from .cases import docs, prose
from .test_operators import plain_line_dedup


def test_written_ids_meet_python_in_bounded_batches(spark, monkeypatch):
    """The ids are read back for their sums in batches of ROWS rows, and no Python is left for whoever reads the result."""
    monkeypatch.setattr(token_output, "ROWS", 7)
    sizes, made = [], token_output.materialize

    def kept(df, name="table", batch=None, **options):
        sizes.append((name, batch))
        return made(df, name, batch, **options)

    monkeypatch.setattr(token_output, "materialize", kept)
    out = token_output.report(docs(spark, [prose(50, i) for i in range(30)]))
    assert ("token-counts", 7) in sizes
    assert "Arrow" not in out._jdf.queryExecution().executedPlan().toString()
    assert [r.doc_id for r in out.orderBy("start").collect()] == list(range(30))


def test_line_links_of_near_copies_are_counted_by_group(spark, monkeypatch):
    """Near copies with overlapping changes have the links of brute force, and few of them are rows."""
    r = random.Random(3)
    base, other = prose(60, 1).split(), prose(60, 2).split()
    pool, lines = [f"edit{i}" for i in range(60)], []
    for _ in range(150):
        own = list(base if r.random() < 0.8 else other)
        for at in r.sample(range(len(own)), r.randint(0, 3)):
            own[at] = r.choice([*pool, "", f"new{r.random()}"])
        lines.append(" ".join(own))
    texts = ["\n".join(lines[i : i + 3]) for i in range(0, 150, 3)]
    rows, made = {}, line_dedup.materialize

    def kept(df, name="table", *a, **k):
        out = made(df, name, *a, **k)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(line_dedup, "materialize", kept)
    got = {x.doc_id: (x.n_lines, x.n_removed, x.n_links, x.removed_lines) for x in line_dedup.report(docs(spark, texts)).collect()}
    want = plain_line_dedup(list(enumerate(texts)))
    assert got == want
    assert rows["links"] + rows["changed"] < sum(x[2] for x in want.values()) / 4
