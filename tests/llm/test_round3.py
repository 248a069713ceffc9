"""Exact dedup, ranked search and conversation repair against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from pagesift.llm import exact_dedup, ranked_search, repair

from .cases import ODD, docs, own_columns, prose, with_clashes


# exact dedup

def plain_groups(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[text or ""].append(doc)
    return {(d, max(g), len(g), d == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g}


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_exact_dedup_equals_groups(spark, parts):
    """Also over more runs than meet in a round."""
    r = random.Random(1)
    texts = ODD + [r.choice(["hot", "hot", f"t{r.randint(0, 40)}", f"T{r.randint(0, 40)}", "é", "é"]) for _ in range(300)]
    found = exact_dedup.report(docs(spark, texts).repartition(parts))
    assert {tuple(x) for x in found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()} == plain_groups(enumerate(texts))
    assert found.count() == len(texts)


def test_exact_dedup_tells_equal_short_digests_apart(spark):
    rows = [(1, 7, b"a", 1), (2, 7, b"b", 1), (3, 7, b"a", 1), (4, 7, b"a", 2)]
    runs = spark.createDataFrame([(*r[1:], r[0], r[0], r[0] % 2) for r in rows], "d long, sha binary, bytes int, id long, row long, run int")
    merged = {(bytes(x.sha), x.bytes): (x.n, x.keep.id) for x in exact_dedup.merge_runs(runs, 1).collect()}
    assert merged == {(b"a", 1): (2, 3), (b"b", 1): (1, 2), (b"a", 2): (1, 4)}


def test_exact_dedup_keeps_rows_and_columns(spark):
    rows = with_clashes(docs(spark, ODD + ["same", "twice", "twice", "null id"], ids=[*range(len(ODD)), 90, 7, 7, None]))
    kept = exact_dedup.deduplicate(rows)
    assert kept.columns == rows.columns and own_columns(kept)
    texts = Counter(r.text or "" for r in kept.collect())
    assert texts == {t: 1 for t in {*(t or "" for t in ODD), "twice", "null id"}}
    assert {r.doc_id for r in kept.where("text = 'same'").collect()} == {90}
    assert exact_dedup.report(rows).where("kept").count() == len(texts)
    empty = rows.limit(0)
    assert exact_dedup.report(empty).count() == exact_dedup.deduplicate(empty).count() == 0


def test_exact_dedup_has_no_python(spark):
    plan = exact_dedup.report(docs(spark, ODD))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ranked search

def terms_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain_ranks(rows, items, top=10):
    own = [(d, Counter(terms_of(t)), len(terms_of(t))) for d, t in rows]
    n_docs, total = sum(n > 0 for *_, n in own), sum(n for *_, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = set()
    for item, text in items:
        scored = []
        for d, c, n in own:
            m = 25 + (75 * n * n_docs) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms_of(text) if c[t])
            if score > 0:
                scored.append((-score, d))
        out |= {(item, i, d, -s) for i, (s, d) in enumerate(sorted(scored)[:top], 1)}
    return out


def searched(spark, texts, items, **options):
    asked = spark.createDataFrame(items, "item_id long, text string")
    return {tuple(r) for r in ranked_search.search(docs(spark, texts).repartition(3), asked, **options).select("item_id", "rank", "doc_id", "score").collect()}


@pytest.mark.parametrize("options", [{}, {"block": 7}, {"pairs_per_pass": 50}])
def test_ranked_search_equals_scoring_all(spark, options):
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["É", "naïve", "X1", "日本"]
    texts = ODD + [" ".join(r.choices(words, [1 / (i + 1) for i in range(len(words))], k=r.randint(1, 90))) for _ in range(400)]
    texts += [texts[-1]] * 30  # ties
    items = [(i, " ".join(r.choices(words, k=r.randint(1, 120)))) for i in range(12)] + [(20, None), (21, "!?"), (22, "unseen"), (23, "same the THE")]
    assert searched(spark, texts, items, **options) == plain_ranks(enumerate(texts), items)


def test_ranked_search_of_empty_tables(spark):
    assert searched(spark, [None, "", "?"], [(1, "a")]) == set()
    assert searched(spark, ["a"], [(1, None)]) == set()
    assert ranked_search.report(docs(spark, ["a"]).limit(0), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0
    assert ranked_search.report(docs(spark, ["a"]), spark.createDataFrame([], "item_id string, text string")).count() == 0


def test_ranked_search_odd_rows(spark):
    rows = with_clashes(docs(spark, ["a b", "a b", "a", None], ids=[5, None, 3, None]))
    items = spark.createDataFrame([("x", "b", "own"), ("x", "b", "own"), (None, "a a", "own")], "item_id string, text string, rank string")
    found = [tuple(r)[:3] for r in ranked_search.report(rows, items).orderBy("item_id", "rank").collect()]
    assert found == [(None, 1, 3), (None, 2, 5), (None, 3, None), ("x", 1, 5), ("x", 2, None)]


def test_masks_stop_early():
    """Documents whose mask cannot reach the best are not scored."""
    import numpy as np

    n = 500
    ids, lengths = list(range(n)), np.full(n, 2)
    terms = np.array([x for i in range(n) for x in ((0, 1) if i < 20 else (0, 2))])
    block = ranked_search.Block(ids, lengths, np.arange(0, 2 * n + 1, 2), terms, np.ones(2 * n, np.int64), np.array([10, 900, 1]), n, 2 * n)
    scored = []
    scores = block.scores
    block.scores = lambda docs, counted: scored.extend(docs) or scores(docs, counted)
    best = ranked_search.best_of(block, np.array([0, 1, 2]), np.array([1, 1, 1]), [], np.zeros(3, np.int64), 10)
    assert [x for *_, x in best] == list(range(10)) and len(scored) < 60


# conversation repair

INITIALS = {"s", "u", "a"}


def plain_repair(rows):
    """Least (cost, audit) of one conversation's rows (role initial, fault), by trying all edits."""
    accept = {0: True, 1: False, 2: False, 3: True}

    @lru_cache(None)
    def best(k, state, inserted):
        found = [(0, "")] if k == len(rows) and accept[state] else []
        step = lambda cost, edit, rest: [(cost + rest[0], edit + rest[1])] if rest else []
        if inserted < 3:
            found += step(3, "I", best(k, 3 if state == 2 else 2, inserted + 1))
        if k < len(rows):
            initial, fault = rows[k]
            found += step(4, "D", best(k + 1, state, 0))
            if fault in "-t":
                more = 3 if fault == "t" else 0
                if initial == "s" and state == 0 or initial == "u" and state != 2 or initial == "a" and state == 2:
                    found += step(more, "K", best(k + 1, {"s": 1, "u": 2, "a": 3}[initial], 0))
                found += step(3 + more, "R", best(k + 1, 3 if state == 2 else 2, 0))
        return min(found) if found else None

    return best(0, 0, 0)


def plain_report(rows):
    """Rows (conv_id, turn, role, text) in table order to the contract's results."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv]
        role, text = " " if role is None else role, " " if text is None else text
        mark = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if mark == 0:
            continue
        text = "" if mark == 1 else re.sub("[.!?]", "", text) if mark == 2 else text
        by[conv] += [(turn, "user" if mark == 4 else role, text)] * (2 if mark == 3 else 1)
    out = {}
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        seen, faults = set(), []
        for _, role, text in own:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "-")
            seen.add((role, text))
        initials = [r[1][:1] for r in own]
        cost, audit = plain_repair(tuple(zip(initials, faults)))
        turns = [r[0] for r in own if r[0] is not None]
        lines, k, state = [], 0, 0
        for e in audit:
            if e == "D":
                k += 1
                continue
            name = "assistant" if state == 2 else "user"
            if e == "K":
                name = own[k][1]
            lines.append(f"{name}:{own[k][2] if e in 'KR' else ''}")
            k += e in "KR"
            state = {"s": 1, "u": 2, "a": 3}[name[0]]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


CONV = "conv_id long, turn long, role string, text string"
NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def results(df):
    return {r.conv_id: tuple(r[n] for n in NAMES) for r in df.collect()}


def conversations(seed, n):
    r = random.Random(seed)
    rows = []
    for conv in range(n):
        turn = r.choice([0, 0, 3])
        for k in range(r.choice([1, 2, 4, 6, 9, 17])):
            role = r.choice(["user", "assistant", "system", "tool"]) if r.random() < 0.3 else ("user", "assistant")[k % 2]
            rows.append((conv, turn, role, r.choice(["Hi.", "Yes!", "", " \n", "Cut", "One two?", f"t{r.randint(0, 9)}.", f"x {k} é."])))
            turn += r.choice([1, 1, 1, 2])
    return rows


def test_repair_equals_trying_all(spark):
    rows = conversations(3, 150) + [(900, None, None, None), (901, None, "user", "A."), (None, 1, "user", "B."), (None, 2, "assistant", "C"), (902, 1, "", "x.")]
    found = repair.report(spark.createDataFrame(rows, CONV).repartition(3))
    assert found.count() == len({r[0] for r in rows})
    assert results(found) == plain_report(rows)


def test_repair_of_long_conversations_in_many_pieces(spark):
    """Small segments and pieces over several tasks give what one search gives."""
    r = random.Random(9)
    rows = [(7, k, r.choice(["user", "assistant", "assistant", "user", "system"]), r.choice(["Yes.", f"n{k}.", "cut", ""])) for k in range(120)] + conversations(11, 20)
    frame = spark.createDataFrame(rows, CONV)
    found = results(repair.repair(repair.damage(frame), segment=3, piece_rows=8))
    expected = plain_report(rows)
    assert found == {k: v for k, v in expected.items() if k in found} and 7 in found
    assert results(repair.repair(repair.damage(frame), piece_chars=1)) == found


@pytest.mark.parametrize("seed", range(4))
def test_search_finds_least_edits(seed):
    r = random.Random(seed)
    for _ in range(150):
        rows = [(r.choice("uuaast "), r.choice("----btd")) for _ in range(r.randint(1, 9))]
        ends = {s: c for s, (c, _) in repair.END.items()}
        costs, audits = repair.searched_piece(rows, range(4), r.choice([1, 2, 4, 32]))
        cost, way = repair.joined([costs], [repair.ranks(costs, audits)], 0, ends)
        assert (cost, audits[way[0]] + repair.END[way[0] % 4][1]) == plain_repair(tuple(rows)), rows


def test_lower_bounds_hold():
    r = random.Random(2)
    for _ in range(200):
        rows = [(r.choice("uuaast"), r.choice("----btd")) for _ in range(r.randint(1, 8))]
        low = repair.lower_bounds(rows)
        for entry in range(4):
            for goal in range(4):
                cost, _ = repair.search(rows, entry, goal)
                assert low[0] <= cost


def test_repair_of_odd_tables(spark):
    frame = spark.createDataFrame([], CONV)
    assert repair.report(frame).count() == 0
    dropped = next(k for k in range(100) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    own = spark.createDataFrame([(dropped, 0, "user", "Hi.")], CONV).withColumn("n", F.lit("own")).withColumn("fault", F.lit("own"))
    assert results(repair.report(own)) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    long_text = [(1, 1, "user", prose(20_000, 3) + "."), (1, 2, "assistant", "x" * 100_000)]
    assert results(repair.report(spark.createDataFrame(long_text, CONV))) == plain_report(long_text)


# pages and workers

def test_walk_over_odd_pages():
    from pagesift.llm import warc as W

    assert W.links(b'<a title="go href=foo" href="/r"><!-- <a href="/c"> --><a title="a>b" href=\'/x\'>hi</a><script>"<a href=q>"</script><A HREF=/u?a=1&amp;b=2><a><a href><abbr href=/n><template><a href=/t></template><noscript><a href=/v></noscript>') == [b"/r", b"/x", b"/u?a=1&b=2", b"/v"]
    assert W.visible_text(b'<a title="a>b" href="/x">hi</a> 1 < 2<br>x<template>no</template><p>y<script>z') == b"hi 1 < 2\nx\ny"
    assert W.visible_text(b'<head><title>T</title><script>"</head>"</script></head><body>x<header>y</header>') == b"x\ny"
    assert W.visible_text(b"<head>never closed <b>text</b>") == b"never closed text" and W.visible_text(b"a<!-- open") == b"a"
    assert W.visible_text(b"a <style>x</style>b <STYLE >c</STYLE> d &lt;b&gt; <b") == b"a b d <b>"
    assert W.title(b"<!-- <title>no</title> --><title> a\n b</title><title>c</title>") == b" a b" and W.title(b"<title>open") == b""


@pytest.mark.parametrize("part", [b"<script ", b"<!-- ", b"<a ", b'<a href="', b"<title>", b"<noscript>", b"<head>", b"<a b='", b"</script "])
def test_walk_is_linear(part):
    """Pages of a megabyte that no end tag ends; a pass that went back would take minutes."""
    import time

    from pagesift.llm import warc as W

    began = time.process_time()
    W.visible_text(part * (1_000_000 // len(part)))
    assert time.process_time() - began < 5


def test_warc_files_by_bytes(spark, tmp_path):
    from pagesift.llm import warc as W

    made = W.report(spark.createDataFrame([(i, "u", f"<p>{'x' * 5000} {i}</p>") for i in range(20)], "page_id long, url string, html string"))
    for k, options in enumerate(({}, {"bytes_per_file": 30_000}, {"per_file": 10})):
        W.write(made, f"{tmp_path}/{k}", **options)
        assert sorted(map(repr, W.read(spark, f"{tmp_path}/{k}").collect())) == sorted(map(repr, made.collect()))
    assert len(list((tmp_path / "1").glob("*.txt"))) > len(list((tmp_path / "0").glob("*.txt")))


def test_workers_build_once(spark):
    """Tasks of one worker share what is made from a broadcast."""
    sent = spark.sparkContext.broadcast(["a", "b"])

    def built(batches):
        import os
        import uuid

        from pagesift.llm.common import once

        for pdf in batches:
            yield pdf.assign(made=once(sent.value, lambda v: f"{uuid.uuid4()}"), pid=os.getpid())

    rows = spark.range(0, 4000, 1, 16).mapInPandas(built, "id long, made string, pid long")
    one, two = (rows.select("made", "pid").distinct().collect() for _ in range(2))
    assert len({r.made for r in one}) == len({r.pid for r in one}) < 16
    assert {(r.pid, r.made) for r in one} & {(r.pid, r.made) for r in two}
