"""DuckDB SQL for the queries that SQL can express, written from the definitions, not from the Spark plans.

Sentence piece counts (op4), chunk digests (op5), byte-level ids (op6) and XXH64 fingerprints (op7) are no SQL
functions, and no SQL here searches edits (op13); the tests compare those queries with brute-force versions.
"""

from __future__ import annotations

from .license_scan import CAPITAL, CUT, RULES, SENTENCE_HINT, SENTENCES, WORD_HINT, WRAPPED
from .warc import DATE

#: The forms of the tags and references that the given pages have.
_HIDDEN = (r"(?s)<!--.*?-->", *(rf"(?is)<{t}(?:[\x20\x09-\x0D/][^>]*)?>.*?</{t}[^>]*>" for t in ("script", "style", "head", "noscript")))
_BREAKS = r"(?i)<(?:br|/?(?:p|div|h[1-6]|li|ul|ol|tr|table|nav|article|section|header|footer|aside|main|title|blockquote|pre|hr|body|html))(?:[\x20\x09-\x0D/][^>]*)?>"
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&reg;", "®"), ("&middot;", "·"), ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&euro;", "€"))
_WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _license_scan() -> str:
    cases = " ".join(f"WHEN regexp_full_match(n, {_q(p)}) THEN {_q(i)}" for i, p in SENTENCES)
    norm = lambda x: f"regexp_replace(replace(replace(regexp_replace(' ' || regexp_replace(lower({x}), '[^a-z0-9.()+/-]+', ' ', 'g') || ' ', ' [-*/+.#]+ ', ' ', 'g'), '( ', '('), ' )', ')'), '^[ .]+|[ .]+$', '', 'g')"
    steps = []
    for k, (name, ids) in enumerate(RULES):
        seq = _q("".join(f"<{i}>" for i in ids))
        steps.append(f"r{k + 1} AS (SELECT doc_id, replace(rest, {seq}, '|') rest, CASE WHEN contains(rest, {seq}) AND NOT list_contains(lic, {_q(name)}) THEN list_append(lic, {_q(name)}) ELSE lic END lic FROM r{k})")
    return f"""
WITH cut AS (SELECT doc_id, string_split_regex(text, {_q(CUT)}) s FROM documents WHERE regexp_matches(text, {_q(WORD_HINT)})),
coarse AS (SELECT doc_id, i, s[i] raw FROM cut, unnest(range(1, len(s) + 1)) r(i)),
parted AS (SELECT doc_id, i, CASE WHEN contains(raw, chr(10)) AND regexp_full_match({norm("raw")}, {_q(WRAPPED)}) THEN [raw] ELSE string_split(regexp_replace(raw, {_q(CAPITAL)}, chr(1) || '\\1', 'g'), chr(1)) END p FROM coarse),
one AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 pos, p[j] raw FROM parted, unnest(range(1, len(p) + 1)) r(j)),
norm AS (SELECT doc_id, pos, {norm("raw")} n FROM one),
named AS (SELECT doc_id, pos, CASE {cases} END id FROM norm WHERE regexp_matches(n, {_q(SENTENCE_HINT)})),
seqs AS (SELECT doc_id, count(*) n_sentences, string_agg(id, ',' ORDER BY pos) sentence_ids, string_agg(pos::VARCHAR, ',' ORDER BY pos) positions, string_agg('<' || id || '>', '' ORDER BY pos) rest FROM named WHERE id IS NOT NULL GROUP BY doc_id),
r0 AS (SELECT doc_id, rest, []::VARCHAR[] lic FROM seqs), {", ".join(steps)}
SELECT d.doc_id, coalesce(n_sentences, 0) n_sentences, coalesce(sentence_ids, '') sentence_ids, coalesce(positions, '') positions, coalesce(array_to_string(r.lic, ','), '') licenses,
 coalesce(array_to_string(regexp_extract_all(r.rest, '<([a-z0-9_]+)>', 1), ','), '') unused
FROM documents d LEFT JOIN seqs USING (doc_id) LEFT JOIN r{len(RULES)} r USING (doc_id)"""


_DECONTAMINATE = rf"""
WITH dw AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(w)) n, list_slice(w, i, i + least(13, len(w)) - 1) g FROM iw, unnest(range(1, len(w) - least(13, len(w)) + 2)) r(i) WHERE len(w) > 0),
pos AS (SELECT doc_id, i, n, list_slice(w, i, i + n - 1) g FROM dw, (SELECT DISTINCT n FROM win), unnest(range(1, len(w) - n + 2)) r(i)),
occ AS (SELECT doc_id, i, pos.n, item_id FROM pos JOIN win ON pos.n = win.n AND pos.g = win.g),
hit AS (SELECT doc_id, count(DISTINCT p) n_hit FROM occ, unnest(range(i, i + n)) r(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) n_items, string_agg(x, ',' ORDER BY x) ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR x FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""


def _unescape(x: str) -> str:
    for name, value in _ENTITIES:
        x = f"replace({x}, {_q(name)}, {_q(value)})"
    code = "CASE WHEN lower(substr(r, 3, 1)) = 'x' THEN ('0x' || substr(r, 4, length(r) - 4))::BIGINT ELSE substr(r, 3, length(r) - 3)::BIGINT END"
    good = f"({code}) >= 32 AND ({code}) < 1114111 AND NOT ({code}) BETWEEN 55296 AND 57343"
    refs = f"list_distinct(regexp_extract_all({x}, '(&#(?:[0-9]{{1,6}}|[xX][0-9a-fA-F]{{1,5}});)', 1))"
    return f"replace(list_reduce(list_concat([{x}], {refs}), lambda a, r: CASE WHEN {good} THEN replace(a, r, chr(({code})::INT)) ELSE a END), '&amp;', '&')"


def _warc() -> str:
    uuid = lambda x: f"'<urn:uuid:' || substr({x}, 1, 8) || '-' || substr({x}, 9, 4) || '-' || substr({x}, 13, 4) || '-' || substr({x}, 17, 4) || '-' || substr({x}, 21, 12) || '>'"
    html = "payload"
    for p in _HIDDEN:
        html = f"regexp_replace({html}, {_q(p)}, ' ', 'g')"
    html = f"regexp_replace(regexp_replace({html}, '[\\x20\\x09-\\x0D]+', ' ', 'g'), {_q(_BREAKS)}, chr(10), 'g')"
    return f"""
WITH src AS (SELECT page_id, coalesce(url, '') url, coalesce(html, '') payload, md5(concat_ws(chr(31), 'response', page_id::VARCHAR, coalesce(url, ''))) h FROM pages),
a AS (SELECT *, {uuid("h")} rid, 'sha256:' || sha256(payload) pd, lower(regexp_extract(payload, '(?i)<meta[^>]*charset=[\\x22'']?([A-Za-z0-9_-]+)', 1)) cs,
 regexp_replace({html}, '<[A-Za-z/!?][^>]*>', '', 'g') bare, regexp_extract(payload, '(?is)<title[^>]*>(.*?)</title', 1) tt,
 list_transform(regexp_extract_all(payload, '(?i)<a[\\x20\\x09-\\x0D][^>]*?href=\\x22([^\\x22]*)\\x22', 1), lambda x: 'outlink: ' || regexp_replace(replace(x, '&amp;', '&'), '[\\r\\n]+', ' ', 'g') || chr(13) || chr(10)) links FROM src),
b AS (SELECT *, {_unescape("bare")} txt, regexp_replace({_unescape("tt")}, '[\\x20\\x09-\\x0D]+', ' ', 'g') title FROM a),
c AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(txt, '[\\x20\\x09]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g') body,
 'title: ' || title || chr(13) || chr(10) || array_to_string(links, '') || 'source-header: HTTP/1.1 200 OK' || chr(13) || chr(10) || 'source-header: Content-Type: text/html' || CASE WHEN cs <> '' THEN '; charset=' || cs ELSE '' END || chr(13) || chr(10)
 || 'source-header: Content-Length: ' || strlen(payload)::VARCHAR || chr(13) || chr(10) || 'source-digest: ' || pd || chr(13) || chr(10) meta FROM b),
u AS (SELECT page_id, 'metadata' record_type, md5(concat_ws(chr(31), 'metadata', rid)) h, rid, url, 'application/warc-fields' content_type, pd, meta block FROM c
 UNION ALL SELECT page_id, 'conversion', md5(concat_ws(chr(31), 'conversion', rid)), rid, url, 'text/plain', pd, body FROM c)
SELECT page_id, record_type, {uuid("h")} record_id, rid refers_to, url target_uri, '{DATE}' warc_date, content_type, pd payload_digest, 'sha256:' || sha256(block) block_digest, strlen(block)::BIGINT content_length, block FROM u"""


_LINES = r"""
WITH ln AS (SELECT doc_id, i - 1 line_no, s[i] line FROM (SELECT doc_id, string_split(text, chr(10)) s FROM documents WHERE doc_id IS NOT NULL), unnest(range(1, len(s) + 1)) r(i) WHERE regexp_matches(s[i], '[^\x20\x09-\x0D]')),
k AS (SELECT doc_id, line_no, trim(translate(line, chr(9) || chr(11) || chr(12) || chr(13), '    ')) key FROM ln),
cls AS (SELECT key, min(struct_pack(d := doc_id, l := line_no)) f, list_distinct(regexp_extract_all(lower(key), '[^\x20\x09-\x0D]+')) w FROM k GROUP BY key),
tok AS (SELECT f, len(w) n, unnest(w) t FROM cls),
par AS (SELECT a.f f1, b.f f2, a.n n1, b.n n2, count(*) o FROM tok a JOIN tok b ON a.t = b.t AND a.f < b.f AND 4 * a.n <= 5 * b.n AND 4 * b.n <= 5 * a.n GROUP BY ALL HAVING 9 * count(*) >= 4 * (a.n + b.n)),
lnk AS (SELECT f, count(*) n, bool_or(later) later FROM (SELECT f1 f, false later FROM par UNION ALL SELECT f2, true FROM par) GROUP BY f),
jdg AS (SELECT k.doc_id, k.line_no, coalesce(lnk.n, 0) n, cls.f <> struct_pack(d := k.doc_id, l := k.line_no) OR coalesce(later, false) removed FROM k JOIN cls USING (key) LEFT JOIN lnk ON lnk.f = cls.f)
SELECT doc_id, count(*) n_lines, count(*) FILTER (WHERE removed) n_removed, sum(n)::BIGINT n_links, coalesce(string_agg(line_no::VARCHAR, ',' ORDER BY line_no) FILTER (WHERE removed), '') removed_lines FROM jdg GROUP BY doc_id"""


def _mixing(rounds: int = 16) -> str:
    units = ["u0 AS (SELECT 0::DOUBLE u)"]
    for k in range(rounds):
        over = f"w * u{k}.u > 3.0::DOUBLE * s"
        units.append(f"u{k + 1} AS (SELECT coalesce(((SELECT sum(s) FROM src)::DOUBLE - coalesce(sum(CASE WHEN {over} THEN 3.0::DOUBLE * s END), 0)) / nullif(sum(CASE WHEN NOT ({over}) THEN w END), 0), any_value(u{k}.u)) u FROM src, u{k})")
    key = "md5(concat_ws(':', '42', e::VARCHAR, coalesce(doc_id::VARCHAR, 'null'), size::VARCHAR))"
    return f"""
WITH sz AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::BIGINT size FROM documents),
src AS (SELECT source, sum(size)::BIGINT s, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE w FROM sz GROUP BY source), {", ".join(units)},
tg AS (SELECT source, s source_size, CASE WHEN w * u > 3.0::DOUBLE * s THEN 3.0::DOUBLE * s ELSE w * u END target FROM src, u{rounds}),
cp AS (SELECT doc_id, tg.source, size, target, e FROM sz JOIN tg ON sz.source IS NOT DISTINCT FROM tg.source, unnest(range(1, least(3, ceil(target / source_size)::INT + 1) + 1)) r(e) WHERE size > 0 AND target > 0),
ky AS (SELECT *, {key} k FROM cp),
qd AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY e, k) / target finish FROM ky),
mx AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS FIRST, e, k) run FROM qd),
ct AS (SELECT source, max(struct_pack(e := e, k := k)) last FROM mx WHERE run <= (SELECT sum(size) FROM sz) GROUP BY source),
tk AS (SELECT doc_id, size, source, list_sum(list_transform([1, 2, 3], lambda e: CASE WHEN struct_pack(e := e::BIGINT, k := {key}) <= last THEN 1 ELSE 0 END)) c FROM sz LEFT JOIN ct USING (source))
SELECT doc_id, size, source_size, target, (size * coalesce(c, 0))::BIGINT taken FROM tk LEFT JOIN tg USING (source)"""


_QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () rid, doc_id, source, coalesce(text, '') t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{_WORD}') w FROM d),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] g FROM w, unnest(range(1, len(w) - 1)) r(i)),
rp AS (SELECT rid, count(DISTINCT p) n FROM (SELECT rid, unnest(range(i, i + 3)) p FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) c FROM g) WHERE c > 1) GROUP BY rid),
dl AS (SELECT rid, count(*) - count(DISTINCT x) n FROM (SELECT rid, unnest(string_split(t, chr(10))) x FROM d) WHERE regexp_matches(x, '{_WORD}') GROUP BY rid),
m AS (SELECT w.rid, doc_id, source, len(w)::BIGINT n_words, length(array_to_string(w, ''))::BIGINT word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT n_symbols, coalesce(dl.n, 0) n_dup_lines, coalesce(rp.n, 0) n_repeat_words FROM w LEFT JOIN rp USING (rid) LEFT JOIN dl USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words base_failed, 10 * n_symbols > n_words OR (n_dup_lines >= 3 AND 1000 * n_dup_lines > 3 * n_words) OR word_chars < 2 * n_words OR word_chars > 12 * n_words soft_failed FROM m),
h AS (SELECT source, count(*) n, count(*) FILTER (WHERE base_failed OR soft_failed) k FROM f GROUP BY source),
p AS (SELECT avg(k / n) mean, var_pop(k / n) v, avg(1 / n) inv FROM h),
s AS (SELECT mean, CASE WHEN v - mean * (1 - mean) * inv <= 0 THEN 1000 ELSE least(1000, greatest(2, mean * (1 - mean) / (v - mean * (1 - mean) * inv) - 1)) END strength FROM p),
r AS (SELECT source, (k + mean * strength) / (n + strength) rate FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, soft_failed,
 CASE WHEN rate > 0.5 THEN 'bad' WHEN rate > 0.25 THEN 'watched' ELSE 'good' END host_verdict, NOT base_failed AND NOT (soft_failed AND rate > 0.25) AND rate <= 0.5 kept FROM f JOIN r ON f.source IS NOT DISTINCT FROM r.source"""


_EXACT = """
WITH t AS (SELECT doc_id, coalesce(text, '') body FROM documents)
SELECT doc_id, max(doc_id) OVER g keep_id, count(*) OVER g group_size, doc_id = max(doc_id) OVER g kept, sha256(body) text_sha256 FROM t WINDOW g AS (PARTITION BY body)"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_RANKED = f"""
WITH d AS (SELECT row_number() OVER () r, doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM}'), []) w FROM documents),
st AS (SELECT count(*) FILTER (WHERE len(w) > 0) n, sum(len(w))::BIGINT l FROM d),
tf AS (SELECT r, t, count(*) tf FROM (SELECT r, unnest(w) t FROM d) GROUP BY ALL),
it AS (SELECT item_id, t, count(*) c FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM}')) t FROM benchmark) GROUP BY ALL),
wt AS (SELECT t, floor(1000 * ln((2 * n + 2) / (2 * df + 1)))::BIGINT w FROM (SELECT t, count(*) df FROM tf GROUP BY t), st),
m AS (SELECT r, doc_id, 25 + (75 * len(w) * n) // l m FROM d, st WHERE len(w) > 0),
sc AS (SELECT item_id, r, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT score FROM it JOIN wt USING (t) JOIN tf USING (t) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT "rank", doc_id, score FROM sc WHERE score > 0 QUALIFY "rank" <= 10"""

ORACLES: dict[str, str] = {
    "op1_license_scan": _license_scan(),
    "op2_decontaminate": _DECONTAMINATE,
    "op3_warc": _warc(),
    "op8_line_dedup": _LINES,
    "op9_mixing": _mixing(),
    "op10_quality": _QUALITY,
    "op11_exact_dedup": _EXACT,
    "op12_ranked_search": _RANKED,
}
