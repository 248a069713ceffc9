"""Small documents with the odd cases that every operator must take, and plain versions of the operators."""

import random

LONG = " ".join(f"w{i % 977}" for i in range(60_000))
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, sources=None, ids=None):
    rows = [((ids[i] if ids else i), t, "en", (sources[i] if sources else f"s{i % 3}"), len(t) if t is not None else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(n, seed, vocabulary=5000):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


ODD = [None, "", " ", "\n\n", "a", "A b\nA b\n", "é ü 日本語 テスト\t\x0b x", LONG, "the the the the", prose(200, 1), prose(200, 1), "same", "same", "x" * 50_000]


def with_clashes(df):
    """Extra columns named like the operators' own, inner and outer."""
    from pyspark.sql import functions as F

    names = (
        "hit hit_ q kept fp component_id n_tokens line hits start size size_ _size source_size target copies mix _mix _plan license_scan _known _matched host_rate "
        "base_failed soft_failed quality quality_ host _host _gone _doc _later _merged _t _d _h _base _m _spans _items rate bucket _bucket epoch key finish word words row node"
    )
    return df.select("*", *(F.lit("own").alias(n) for n in names.split()))


def own_columns(df):
    """Whether all those columns still hold their own values."""
    names = [c for c in df.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
    return all(set(r) == {"own"} for r in df.select(*names).distinct().collect())
