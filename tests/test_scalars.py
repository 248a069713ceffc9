"""Character references against Python's own reading, and metrics as JSON."""

import html
import random

from pyspark.sql import functions as F

from pagesift.functions import scalars as S


def test_unescape_equals_python(spark):
    r = random.Random(4)
    parts = ["&lt;", "&amp;lt;", "&eacute;", "&eacute", "&copy2", "&notit;", "&notin;", "&zzz;", "&", "&;", "& x", "&#", "&#x", "&#8217;", "&#x2019", "&#0;", "&#xD800;", "&#128;", "&#x81;", "&#1114112;", "&#99999999999999999999;",
             "&#000065;", "&#7;", "&#xFFFE;", "&#13;", "&#10;", "&#128512;", "&NotEqualTilde;", "&a&b;", "&ampamp;", "text", " é ", "\n", "&CounterClockwiseContourIntegral;", "&am", "&sup1x", "&#x1F600;", "&#0000000065"]
    texts = parts + ["".join(r.choices(parts, k=r.randint(1, 6))) for _ in range(300)] + ["", "plain"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i long, t string")
    got = dict(rows.select("i", S.html_unescape("t")).collect())
    wrong = [(t, got[i], html.unescape(t)) for i, t in enumerate(texts) if got[i] != html.unescape(t)]
    assert not wrong and got[len(texts)] is None
    assert "Python" not in rows.select(S.html_unescape("t"))._jdf.queryExecution().executedPlan().toString()


def test_metrics_round_trip(spark):
    texts = ['{"recall":0.5,"n":3,"note":"x","deep":{"a":[1,2]}}', '{"recall":null}', '{"recall":"high","x":true}', "{}", "bad", "[1]", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("m", S.parse_metrics("t", ("recall", "n")))
    back = rows.select("i", "m.recall", "m.n", S.metrics_json({"recall": "m.recall", "n": "m.n"}, F.col("m.other")).alias("j"), F.col("m").isNull().alias("bad")).orderBy("i").collect()
    assert [(r.recall, r.n) for r in back[:4]] == [(0.5, 3.0), (None, None), (None, None), (None, None)]
    assert back[0].j in ('{"recall":0.5,"n":3.0,"note":"x","deep":{"a":[1,2]}}', '{"recall":0.5,"n":3,"note":"x","deep":{"a":[1,2]}}')
    assert back[3].j == "{}" and [r.bad for r in back] == [False] * 4 + [True] * 3
