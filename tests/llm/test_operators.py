import binascii
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from pagesift.llm import decontaminate, license_scan, line_dedup, mixing, quality, simhash, substring_dedup, token_count, token_output, warc

from .cases import DOCS, LONG, ODD, docs, own_columns, prose, with_clashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


BENCH = "item_id long, text string"


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, prose(40, 9)), (2, "the the the"), (3, None), (4, ""), (None, "same"), (5, prose(40, 9)), (5, "É ü")], BENCH)


REPORTS = {
    "license": license_scan.report,
    "tokens": token_count.report,
    "ids": token_output.report,
    "simhash": simhash.report,
    "mix": mixing.report,
    "quality": quality.report,
}


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_odd_rows_and_empty_tables(spark, odd, empty, name):
    assert REPORTS[name](empty).collect() == []
    assert REPORTS[name](odd).count() == len(ODD)
    twice = odd.union(odd).withColumn("doc_id", F.when(F.col("doc_id") != 3, F.col("doc_id")))
    assert REPORTS[name](twice).count() == 2 * len(ODD)
    assert REPORTS[name](with_clashes(odd)).count() == len(ODD)


# 1 license scan

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin it. The above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED."


@pytest.mark.parametrize("text, licenses, unused", [
    ("Some prose.\nReleased under the MIT License.", "MIT", ""),
    ("Some prose\nReleased under the MIT License", "MIT", ""),
    ("# Licensed under the Apache License, Version 2.0.", "Apache-2.0", ""),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0", ""),
    ("Licensed under CC BY-NC 4.0. All rights reserved.", "CC-BY-NC,All-Rights-Reserved", ""),
    ("Licensed under CC BY 4.0.", "CC-BY", ""),
    ("// " + MIT.replace("\n", "\n// ").replace("// \n", "\n"), "MIT", ""),
    (MIT, "MIT", ""),
    ("You may not use this file except in compliance with the License.", "", "apache2_use"),
    ("A licence to kill. Softly.", "", ""),
])
def test_license_texts(spark, text, licenses, unused):
    row = license_scan.report(docs(spark, [text])).first()
    assert (row.licenses, row.unused) == (licenses, unused)


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
BSD_HEAD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

"""
BSD_NAME = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

"""
BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE."""
GPL = """This program is free software%s you can redistribute it and/or modify
it under the terms of the GNU %sGeneral Public License as published by
the Free Software Foundation%s either version %s of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU %sGeneral Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
UNLICENSE = "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software."
CANONICAL = [
    (APACHE, "Apache-2.0"), (BSD_HEAD + BSD_TAIL, "BSD-2-Clause"), (BSD_HEAD + BSD_NAME + BSD_TAIL, "BSD-3-Clause"), (MIT, "MIT"), (MPL, "MPL-2.0"), (ISC, "ISC"),
    (GPL % (":", "", ",", "3", ""), "GPL-3.0"), (GPL % (";", "", ";", "2", ""), "GPL-2.0"), (GPL % (":", "Lesser ", ",", "3", "Lesser "), "LGPL"), (GPL % (":", "Affero ", ",", "3", "Affero "), "AGPL"), (UNLICENSE, "Unlicense"),
]


def test_canonical_licenses(spark):
    forms = [lambda t: t, lambda t: "/*\n" + "\n".join(" * " + x for x in t.split("\n")) + "\n */", lambda t: "\n".join("# " + x for x in t.split("\n")), lambda t: t.replace(" ", "  "), lambda t: "Copyright (c) 2020 Some One\n\n" + t]
    texts = [(form(t), name) for t, name in CANONICAL for form in forms]
    got = by_id(license_scan.report(docs(spark, [t for t, _ in texts])))
    wrong = {(i, name, got[i].licenses, got[i].sentence_ids) for i, (_, name) in enumerate(texts) if got[i].licenses != name}
    assert not wrong, wrong


def test_license_rules_take_sentences_in_order(spark):
    row = license_scan.report(docs(spark, [MIT])).first()
    assert row.sentence_ids == "mit_grant,mit_notice,mit_warranty" and row.licenses == "MIT"
    found = license_scan.scan(docs(spark, [MIT])).first().license_scan.found
    assert found[0].raw.startswith("Permission is hereby")


def test_license_hints_cover_all_sentences():
    texts = {"mit_by": "released under the mit license"}
    hint = re.compile(license_scan.HINT)
    for name, pattern in license_scan.SENTENCES:
        plain = texts.get(name, re.sub(r"\[cs\]", "s", re.sub(r"\\", "", pattern)))
        assert hint.search(plain), name


@pytest.mark.parametrize(
    "text, ids",
    [
        ("This work is dedicated to the public\n * domain.", "public_domain"),
        ("# all rights\n# reserved", "reserved"),
        ("Released under the CC BY 4.0.", "ccby_by"),
        ("Released under\nthe terms of the CC BY-SA 4.0", "ccbysa_by"),
        ("available under the terms of\n// the creative\n// commons attribution 4.0", "ccby_by"),
    ],
)
def test_license_hints_drop_no_wording(spark, text, ids):
    assert license_scan.report(docs(spark, [text])).first().sentence_ids == ids


def test_license_scan_keeps_own_columns(odd):
    out = license_scan.scan(with_clashes(odd))
    assert own_columns(out.drop("license_scan")) and out.count() == len(ODD)


def test_license_is_native(odd):
    plan = license_scan.report(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# 2 decontamination


def plain_contamination(texts, items, window=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for t in texts:
        own, hit, found = words(t), set(), set()
        for item, x in items:
            iw = words(x)
            n = min(window, len(iw))
            if item is None or not n:
                continue
            windows = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)}
            for i in range(len(own) - n + 1):
                if tuple(own[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found.add(str(item))
        out.append((len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(own)))
    return out


@pytest.mark.parametrize("per_pass", [10**6, 30])
def test_decontamination_equals_brute_force(spark, bench, per_pass):
    items = [tuple(r) for r in bench.collect()]
    passage = prose(40, 9).split()
    texts = [t for t in ODD if t != LONG] + [prose(60, 3) + " " + " ".join(passage[3:20]), " ".join(passage[:12]), " ".join(passage[:13]).upper() + ".", "x the, The!THE é ü É Ü", " ".join(passage) * 2]
    r = random.Random(5)
    items += [(100 + i, " ".join(r.choice("ab cd") for _ in range(r.randint(1, 20)))) for i in range(30)]
    texts += [" ".join(r.choice("abcd") for _ in range(60)) for _ in range(30)]
    found = decontaminate.search(docs(spark, texts), spark.createDataFrame(items, BENCH), words_per_pass=per_pass)
    got = found.select("doc_id", "hit.n_words", "hit.n_hit", F.size("hit.items"), F.sha2(F.array_join("hit.items", ","), 256), decontaminate.contaminated()).orderBy("doc_id").collect()
    assert [tuple(g)[1:] for g in got] == plain_contamination(texts, items)


def test_decontamination_odd(spark, odd, empty, bench):
    assert decontaminate.report(empty, bench).count() == 0
    none = decontaminate.report(odd, spark.createDataFrame([], BENCH))
    assert none.where("contaminated OR n_hit > 0").count() == 0 and none.count() == len(ODD)
    kept = decontaminate.clean(with_clashes(odd), bench)
    assert kept.columns == with_clashes(odd).columns and own_columns(kept)
    many = decontaminate.search(with_clashes(odd), bench, words_per_pass=10, out="found")
    assert own_columns(many.drop("found")) and many.count() == len(ODD)


def test_long_items_are_searched_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE", 50)
    item = prose(400, 77)
    texts = [" ".join(item.split()[i : i + 13]) for i in range(0, 388)] + [" ".join(item.split()[i : i + 12]) for i in (0, 40, 45, 388)]
    found = decontaminate.search(docs(spark, texts), spark.createDataFrame([(1, item)], BENCH), words_per_pass=60)
    assert {r.doc_id: r.hit.n_hit for r in found.collect()} == {i: 13 if i < 388 else 0 for i in range(392)}


# 3 WARC


PAGE = "page_id long, url string, html string"
HTML = '<!DOCTYPE html><html><head><meta charset="UTF-8"><title>A &amp; B</title><style>p{}</style><script>var t="</p>";</script></head><body><!-- x --><p>One &lt;two&gt;<br>&#233;&#x4e2d; &amp;lt;</p><a class="k" href="/a?b&amp;c">L\nM</a><div>end'


def test_warc_keeps_header_text_and_all_href_forms(spark):
    html = "<head><title>t</title></head><body><header class=h><h1>Name</h1><p>visible</p></header><p>x</p>"
    html += "<a href='/one?a&amp;b'>1</a><a class=c href=/two>2</a><a\nhref = \"/three\">3</a><a data-href='/no' href=''>4</a><abbr href='/no'>5</abbr><scripts>6</scripts></body>"
    made = {r.record_type: r.block for r in warc.report(spark.createDataFrame([(1, "http://a/", html)], PAGE)).collect()}
    assert made["conversion"] == "Name\nvisible\nx\n123456"
    assert re.findall("outlink: (.*)\r\n", made["metadata"]) == ["/one?a&b", "/two", "/three", ""]


def test_warc_records(spark, tmp_path):
    rows = [(1, "http://a/", HTML), (1, "http://a/", HTML), (2, None, None), (None, "u", ""), (3, "http://b/", "<p>" + "y" * 100_000)]
    pages = spark.createDataFrame(rows, PAGE).withColumn("record_id", F.lit("own")).withColumn("block", F.lit("own"))
    made = warc.report(pages)
    assert made.count() == 10 and warc.report(spark.createDataFrame([], PAGE)).count() == 0
    first = made.where("page_id = 1 AND record_type = 'conversion'").first()
    assert first.block == "One <two>\né中 &lt;\nL M\nend"
    meta = made.where("page_id = 1 AND record_type = 'metadata'").first()
    assert "title: A & B\r\noutlink: /a?b&c\r\n" in meta.block and "charset=utf-8" in meta.block
    source = warc.responses(pages).where("page_id = 1").first()
    assert first.refers_to == meta.refers_to == source.record_id != first.record_id
    assert first.payload_digest == "sha256:" + hashlib.sha256(HTML.encode()).hexdigest()
    for r in made.collect():
        assert r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest() and r.content_length == len(r.block.encode())
    path = f"{tmp_path}/out"
    warc.write(made, path, per_file=3)
    again = warc.read(spark, path)
    names = [c for c in again.columns]
    assert sorted(map(repr, again.select(names).collect())) == sorted(map(repr, made.select(names).collect()))


# 4 token counts


ALPHABET = ["a", "b", " ", "\n", "é", "▁", "\t", "1", ".", "'s", "the", " the", "日", "<s>", "🙂", "<|endoftext|>", "\x1c", "\r"]


def random_texts(n, seed=3):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(1, 40))) for _ in range(n)]


def test_token_counts_equal_the_library(spark):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_count.MODEL))
    texts = ODD + random_texts(400)
    got = by_id(token_count.report(docs(spark, texts)))
    for i, t in enumerate(texts):
        n = len(model.encode(t or ""))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 4096), t


def test_token_cache_is_bounded():
    import public_tokenizers

    lengths = token_count.Lengths(public_tokenizers.path(token_count.MODEL), {"▁the": 1}, most=50)
    for i in range(500):
        lengths.count(f"w{i} the " + "z" * 100)
    assert len(lengths) <= 51 and max(map(len, lengths)) <= token_count.LONGEST


# 5 substring dedup


def test_cuts_resist_insertions():
    a = prose(400, 11).encode()
    one, two = set(substring_dedup.cuts(a).tolist()), set((substring_dedup.cuts(b"inserted text " + a) - 14).tolist())
    assert len(one & two) > 0.9 * len(one)
    assert max(substring_dedup.cuts(b"a" * 50_000, longest=4096)) == 50_000
    ends = substring_dedup.cuts(b"a" * 50_000, longest=4096)
    assert max(b - a for a, b in zip([0, *ends], ends)) <= 4096


def plain_chunk_spans(rows, least=substring_dedup.SPAN):
    """Spans by comparing whole chunks, not digests, document by document."""
    where, cut = {}, {}
    for doc, text in rows:
        data, at, own = text.encode(), 0, []
        for end in substring_dedup.cuts(data).tolist() if data else []:
            own.append((at, end, data[at:end]))
            where.setdefault(data[at:end], set()).add(doc)
            at = end
        cut[doc] = own
    out = []
    for doc, own in cut.items():
        run = []
        for start, end, chunk in [*own, (None, None, None)]:
            if chunk is not None and len(where[chunk]) > 1 and (not run or run[-1][1] == start):
                run.append((start, end, chunk))
                continue
            if run and run[-1][1] - run[0][0] >= least:
                out.append((doc, run[0][0], run[-1][1], run[-1][1] - run[0][0], min(min(where[c]) for _, _, c in run), sum(e - s for s, e, c in run if min(where[c]) < doc)))
            run = [(start, end, chunk)] if chunk is not None and len(where[chunk]) > 1 else []
    return sorted(out)


def test_substring_spans_equal_brute_force(spark):
    passage = prose(55, 77)
    texts = [prose(150, i) + f" {passage} " + prose(90, 100 + i) if i % 3 == 0 else prose(200, 200 + i) for i in range(30)]
    texts += [texts[1], texts[1] + " more", prose(20, 5)]
    got = sorted(tuple(r) for r in substring_dedup.report(docs(spark, texts)).collect())
    assert got == plain_chunk_spans(list(enumerate(texts)))
    assert {g[0] for g in got} == {i for i in range(30) if i % 3 == 0} | {1, 30, 31}


def test_substring_chunks_of_most_documents(spark):
    passage = prose(60, 79)  # its chunks are in over 1,000 documents, so they are joined in parts
    texts = [f"{prose(5, i)} {passage} {prose(4, 5000 + i)}" for i in range(1100)] + [prose(60, 9000)] * 2 + [prose(60, 9001)]
    got = sorted(tuple(r) for r in substring_dedup.report(docs(spark, texts)).collect())
    assert got == plain_chunk_spans(list(enumerate(texts)))
    assert len({g[0] for g in got}) == 1102


def test_substring_removal_keeps_the_first(spark):
    passage = prose(80, 78)
    texts = [prose(60, 1) + "\n" + passage, passage + "\n" + prose(60, 2), prose(70, 3), None, ""]
    frame = docs(spark, texts).withColumn("digest", F.lit("own")).withColumn("span", F.lit(1))
    out = by_id(substring_dedup.remove(frame))
    assert out[0].text == texts[0] and out[2].text == texts[2] and out[3].text is None and out[4].text == ""
    assert len(out[1].text) < len(texts[1]) - 400 and out[1].text.endswith(texts[1][-100:])
    assert substring_dedup.remove(frame).columns == frame.columns


def test_substring_odd(odd, empty):
    assert substring_dedup.report(empty).count() == 0
    assert {r.doc_id for r in substring_dedup.report(odd).collect()} == {9, 10}
    assert substring_dedup.remove(odd.union(odd)).count() == 2 * len(ODD)


# 6 token ids


def test_token_ids_equal_the_library(spark):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path(token_output.TOKENIZER))
    texts = ODD + random_texts(400)
    shuffled = docs(spark, texts).orderBy(F.rand(1))
    got = by_id(token_output.report(shuffled))
    at = 0
    for i, t in enumerate(texts):
        ids = model.encode(t or "", add_special_tokens=False).ids + [0]
        assert (got[i].start, got[i].n_tokens) == (at, len(ids))
        assert got[i].ids_crc32 == binascii.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_token_encoder_forgets_and_stays_right():
    import numpy as np
    import pyarrow as pa
    import public_tokenizers
    from tokenizers import Tokenizer

    file = public_tokenizers.path(token_output.TOKENIZER)
    model, encoder = Tokenizer.from_file(file), token_output.Encoder(file, most=300)
    for k in range(12):
        texts = [prose(80, seed=k * 10 + i, vocabulary=50).replace(" a", ".\na") for i in range(8)] + [f"x{'y' * 20_000} b", None, "a <|endoftext|> b", "a\xa0b c"]
        ids, n = encoder.encode(pa.array(texts, pa.string()))
        want = [model.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]
        assert n.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])
        assert len(encoder.slot) == len(encoder.ends) - 1 == len(encoder.used) and len(encoder.flat) == encoder.ends[-1]
    assert len(encoder.slot) < 2000
    assert np.array_equal(encoder.encode(pa.array([], pa.string()))[0], [])


def test_token_files_allow_selective_reads(spark, tmp_path):
    import pyarrow.parquet as pq

    token_output.write(docs(spark, [prose(300, i) for i in range(200)]), f"{tmp_path}/ids", files=3)
    files = sorted(tmp_path.glob("ids/*.parquet"))
    column = pq.ParquetFile(files[0]).metadata.row_group(0).column(4)
    assert "RLE_DICTIONARY" in column.encodings and column.has_offset_index and len(files) == 3
    counts = spark.read.schema("doc_id long, n_tokens long").parquet(f"{tmp_path}/ids")
    assert counts.agg(F.sum("n_tokens")).first()[0] == token_output.read(spark, f"{tmp_path}/ids").agg(F.sum(F.size("ids"))).first()[0]


# 7 SimHash


def plain_simhash(rows, width=3):
    from xxhash import xxh64_intdigest

    prints = {}
    for doc, text in rows:
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        grams = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [" ".join(words)] if words else []
        hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
        prints[doc] = sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64)) if hashes else 0
    root = {d: d for d in prints}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {d: (f"{prints[d]:016x}", top(d)) for d in ids}


def test_simhash_equals_brute_force(spark):
    base = prose(300, 21).split()
    texts = list(ODD)
    for i in range(40):
        words = list(base)
        words[i * 7 % 300] = "edit"
        texts.append(" ".join(words[: 300 - i]))
    texts += [prose(50, i) for i in range(40)]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.report(docs(spark, texts)).collect()}
    assert got == plain_simhash(list(enumerate(texts)))
    assert len({c for _, c in got.values()}) < len(texts) - 20


@pytest.mark.parametrize("seed", range(3))
def test_links_find_all_components(spark, seed):
    r = random.Random(seed)
    seeds = [r.getrandbits(64) for _ in range(30)]
    prints = set(seeds)
    for s in seeds:
        for _ in range(r.randint(0, 12)):
            prints.add(s ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
            s = r.choice(list(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"))
    assert links.where("distance > 2").count() == 0
    root = {p: p for p in signed}
    top = lambda p: p if root[p] == p else top(root[p])
    for row in links.collect():
        root[max(top(row.a), top(row.b))] = min(top(row.a), top(row.b))
    want = {p: p for p in signed}
    find = lambda p: p if want[p] == p else find(want[p])
    for i, a in enumerate(signed):
        for b in signed[i + 1 :]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                want[max(find(a), find(b))] = min(find(a), find(b))
    assert {p: top(p) for p in signed} == {p: find(p) for p in signed}


def test_simhash_keeps_one_of_each_group(spark):
    texts = [prose(300, 1), prose(300, 1), prose(300, 2), None, ""]
    frame = with_clashes(docs(spark, texts, ids=[5, 3, 7, 8, None]))
    kept = simhash.deduplicate(frame)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [3, 7, 8] and kept.columns == frame.columns


def plain_near(texts, width=5, similarity=0.8):
    """Smallest index of each text's component of similar shingle sets, all pairs compared."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (not sets[i] and not sets[j]) or (both and both >= similarity * len(sets[i] | sets[j])):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def test_near_duplicates_between_members_that_are_not_first(spark):
    words = prose(300, 41).split()
    shuffled = list(words)
    random.Random(3).shuffle(shuffled)
    texts = [" ".join(shuffled), " ".join(words), " ".join([*words, words[-1]])]
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs(spark, texts)).collect()} == {0: 0, 1: 1, 2: 1}


def test_near_duplicates_equal_brute_force(spark):
    r, texts = random.Random(8), list(ODD)
    for g in range(20):  # chains of edits: members near to one another but not to the first
        words = prose(r.randrange(5, 200), 800 + g).split()
        for k in range(8):
            texts.append(" ".join(words))
            words[r.randrange(len(words))] = f"edit{r.randrange(9)}"
    r.shuffle(texts)
    got = {x.doc_id: x.component_id for x in simhash.near_duplicates(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == plain_near(texts)


def test_long_near_duplicates_equal_brute_force(spark):
    """Sets whose wide parity maps differ in length, on both sides of the similarity, beside sets that share a passage."""
    r, texts = random.Random(21), []
    for size in (900, 1020, 1030, 1900, 2050, 4100):
        words = [f"w{r.randrange(10**6)}" for _ in range(size)]
        for share in (0, 0.01, 0.02, 0.022, 0.023, 0.03, 0.2):  # a changed word changes five shingles
            own = list(words)
            for i in r.sample(range(size), int(share * size)):
                own[i] = f"edit{r.random()}"
            texts.append(" ".join(own))
        texts.append(" ".join(words[: int(0.81 * size)]))
        texts.append(" ".join(words[: int(0.79 * size)]))
        texts.append(" ".join([*words[: size // 4], *(f"w{r.randrange(10**6)}" for _ in range(size))]))
    r.shuffle(texts)
    got = {x.doc_id: x.component_id for x in simhash.near_duplicates(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == plain_near(texts)
    assert len(set(got.values())) > 15


def test_near_duplicates_are_verified_on_shingles(spark):
    r = random.Random(12)
    texts, group = [], []
    for g in range(12):
        base = prose(300, 700 + g).split()
        for k in range(4):
            words = list(base)
            for _ in range(k):
                words[r.randrange(300)] = f"edit{r.random()}"
            texts.append(" ".join(words))
            group.append(g)
    shuffled = prose(300, 700).split()
    r.shuffle(shuffled)
    texts += [" ".join(shuffled), None, "", " "]  # the same words in another order are no duplicate
    group += [100, 101, 101, 101]
    found = {x.doc_id: x.component_id for x in simhash.near_duplicates(docs(spark, texts)).collect()}
    grams = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    for a, c in found.items():
        assert group[a] == group[c] and c <= a
        if a != c and group[a] < 100:
            assert len(grams(texts[a]) & grams(texts[c])) > 0.6 * len(grams(texts[a]) | grams(texts[c]))
    assert len({c for c in found.values()}) <= 14 + 2


# 8 line dedup


def plain_line_dedup(rows):
    lines = [(d, i, x) for d, t in rows if t is not None for i, x in enumerate(t.split("\n")) if WORD.search(x)]
    key = lambda x: x.translate(str.maketrans("\t\x0b\x0c\r", "    ")).strip(" ")
    first = {}
    for d, i, x in sorted(lines):
        first.setdefault(key(x), (d, i))
    sets = [(f, set(WORD.findall(k.lower()))) for k, f in first.items()]
    links, later = {}, set()
    for a, x in sets:
        for b, y in sets:
            if a < b and 5 * len(x & y) >= 4 * len(x | y):
                links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
                later.add(b)
    out = {}
    for d, i, x in sorted(lines):
        f = first[key(x)]
        row = out.setdefault(d, [0, 0, []])
        row[0] += 1
        row[1] += links.get(f, 0)
        if f != (d, i) or f in later:
            row[2].append(i)
    return {d: (n, len(r), k, ",".join(map(str, r))) for d, (n, k, r) in out.items()}


def test_line_dedup_equals_brute_force(spark):
    r = random.Random(8)
    pool = ["".join(r.choice("abcdef") for _ in range(r.randint(1, 4))) for _ in range(60)]
    base = [" ".join(r.choice(pool) for _ in range(r.randint(1, 30))) for _ in range(60)]
    texts = []
    for _ in range(80):
        own = []
        for _ in range(r.randint(1, 6)):
            words = r.choice(base).split()
            if len(words) > 3 and r.random() < 0.6:
                words[r.randrange(len(words))] = r.choice(pool)
            own.append(r.choice(["", "\t", " "]) + " ".join(words) if r.random() < 0.9 else "")
        texts.append("\n".join(own))
    texts += [t for t in ODD if t not in ("x" * 50_000,)]
    got = {x.doc_id: (x.n_lines, x.n_removed, x.n_links, x.removed_lines) for x in line_dedup.report(docs(spark, texts)).collect()}
    assert got == plain_line_dedup(list(enumerate(texts)))


def test_line_removal(spark, odd, empty):
    texts = ["one two three four five\nnext line here", "next line here\n\nlast one", None, "One two three four five\n"]
    frame = with_clashes(docs(spark, texts))
    out = line_dedup.remove(frame)
    assert [r.text for r in out.orderBy("doc_id").collect()] == ["one two three four five\nnext line here", "\nlast one", None, ""] and out.columns == frame.columns and own_columns(out)
    assert line_dedup.report(empty).count() == 0 and line_dedup.remove(odd).count() == len(ODD)
    no_id = docs(spark, ["a b", "a b"], ids=[None, 1])
    assert sorted(str(r.text) for r in line_dedup.remove(no_id).collect()) == ["a b", "a b"]


# 9 mixing


def test_mixing_meets_targets(spark):
    r = random.Random(4)
    sources = ["a"] * 300 + ["b"] * 60 + ["c"] * 20 + [None] * 10
    texts = [prose(r.randint(0, 40), i) for i in range(390)]
    frame = docs(spark, texts, sources)
    got = mixing.report(frame).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.report(frame.repartition(7)).collect()))
    size = {}
    for t, s in zip(texts, sources):
        size[s] = size.get(s, 0) + len(WORD.findall(t))
    total, weight = sum(size.values()), {"a": 1, "b": 2, "c": 3, None: 1}
    goal, capped = {}, set()
    while True:
        unit = (total - sum(3 * size[s] for s in capped)) / sum(weight[s] for s in size if s not in capped)
        more = {s for s in size if s not in capped and weight[s] * unit > 3 * size[s]}
        if not more:
            break
        capped |= more
    goal = {s: 3.0 * size[s] if s in capped else weight[s] * unit for s in size}
    taken = {}
    for row in got:
        s = sources[row.doc_id]
        assert row.source_size == size[s] and abs(row.target - goal[s]) < 1e-6 and row.taken <= 3 * row.size and (not row.size or row.taken % row.size == 0)
        taken[s] = taken.get(s, 0) + row.taken
    assert all(abs(taken[s] - goal[s]) <= 40 for s in size) and sum(taken.values()) <= total


def test_mix_repeats_rows(spark):
    frame = docs(spark, [prose(20, i) for i in range(40)], ["a"] * 36 + ["b"] * 4)
    out = mixing.mix(with_clashes(frame))
    assert out.columns == with_clashes(frame).columns and own_columns(out)
    copies = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    words = {r.doc_id: r.taken // 20 for r in mixing.report(frame).collect()}
    assert copies == {d: n for d, n in words.items() if n}
    assert max(copies[d] for d in range(36, 40)) == 3


# 10 quality


def plain_metrics(t):
    t = t or ""
    words = WORD.findall(t)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {g for g in grams if grams.count(g) > 1} if len(grams) < 3000 else {g for g, n in __import__("collections").Counter(grams).items() if n > 1}
    covered = {p for i, g in enumerate(grams) if g in twice for p in range(i, i + 3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality_metrics_equal_brute_force():
    r = random.Random(2)
    texts = ODD + ["".join(r.choice(["a", "b", " ", "\n", "#", "é", "a b a", "\t", " "]) for _ in range(r.randint(0, 60))) for _ in range(500)]
    for t in texts:
        assert quality.metrics_of(None if t is None else t.encode()) == plain_metrics(t), t


def test_hosts_decide_on_soft_failures(spark):
    good, soft, bad = prose(80, 1), prose(80, 2) + " $$$$$$$$$$", "x y"
    texts = [good] * 40 + [soft] * 2 + [soft] * 30 + [good] * 3 + [bad]
    sources = ["fine"] * 42 + ["poor"] * 33 + [None]
    got = quality.judge(docs(spark, texts, sources)).collect()
    kept = {(r.source, texts[r.doc_id]): r.quality.kept for r in got}
    assert kept == {("fine", good): True, ("fine", soft): True, ("poor", soft): False, ("poor", good): False, (None, bad): False}
    rates = {r.source: r.quality.host_rate for r in got}
    assert 2 / 42 < rates["fine"] < 0.25 and 0.5 < rates["poor"] < 30 / 33
    assert {r.source: r.quality.host_verdict for r in got}["poor"] == "bad"
    watched = quality.judge(docs(spark, [good] * 40 + [soft] * 14 + [good] * 26, ["fine"] * 40 + ["poor"] * 40)).where("source = 'poor'").collect()
    assert {(r.quality.host_verdict, r.quality.soft_failed, r.quality.kept) for r in watched} == {("watched", True, False), ("watched", False, True)}


def test_prior_strength():
    assert quality.prior_strength(0.2, 0.0, 0.1) == 1000.0
    assert quality.prior_strength(0.0, 0.0, 0.0) == 1000.0
    assert abs(quality.prior_strength(0.5, 0.05, 0.0) - 4.0) < 1e-9


def test_quality_keeps_columns(spark, odd):
    frame = with_clashes(odd.union(docs(spark, [prose(90, i) for i in range(40)])))
    kept = quality.keep_good(frame)
    assert kept.columns == frame.columns and kept.count() > 20 and own_columns(kept)
