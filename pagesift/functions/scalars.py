"""Scalar column functions. Inputs may be names or columns; nulls give null unless stated."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
SHEET = r"(?i)\bA[-.]?[0-9]"
SITE = r"(?i)\bsite[-\s]+plans?\b"
# Words in a file name that speak for a drawing.
PLAN_WORDS = ("arch", "floor", "plan", "drawing", "dwg", "cd set", "cd drawings", "construction doc", "layout", "elevation", "interior", "permit set", "issued for")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value, f) -> Column:
    """``f`` of a column that is evaluated once, however often ``f`` names it; lambdas would evaluate it at each place."""
    return F.get(F.transform(F.array(col(value)), f), F.lit(0))


def parse_money(c) -> Column:
    """A dollar amount as double: blanks, ``$`` and ``,`` removed; null where the rest is not a number."""
    bare = F.regexp_replace(F.trim(col(c)), "[$,]", "")
    return F.when(bare.rlike(NUMBER), bare.try_cast("double"))


def issue_year(c) -> Column:
    """The four digits that a text starts with, as int; null without them."""
    return F.nullif(F.regexp_extract(F.trim(col(c)), "^([0-9]{4})", 1), F.lit("")).try_cast("int")


def upgrade_https(c) -> Column:
    """A trimmed URL with ``http://`` in front replaced by ``https://``; null gives an empty text."""
    return F.regexp_replace(F.trim(F.coalesce(col(c), F.lit(""))), "^http://", "https://")


#: A character reference: a number in one of two bases, or a name, with or without a semicolon.
REFERENCE = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


def _names() -> tuple[dict[str, str], dict[str, str]]:
    """All names of HTML 5 with what they stand for, and those of them that need no semicolon."""
    from html.entities import html5

    return html5, {k: v for k, v in html5.items() if not k.endswith(";")}


def _literal_map(table: dict[str, str]) -> Column:
    import json

    return F.from_json(F.lit(json.dumps(table)), "map<string,string>")  # folded to one literal


def _find(table: dict[str, str], key: Column) -> Column:
    """The value of a key, or null. Spark searches a map from its start, so the table is dealt to short ones by CRC-32."""
    import json
    from zlib import crc32

    parts = [{} for _ in range(len(table) // 2 + 1)]
    for k, v in table.items():
        parts[crc32(k.encode()) % len(parts)][k] = v
    dealt = F.from_json(F.lit(json.dumps(parts)), "array<map<string,string>>")
    return F.get(dealt, F.pmod(F.crc32(key.cast("binary")), F.lit(len(parts))).cast("int"))[key]


def _utf8(code: Column) -> Column:
    """The character of a code point; Spark's ``char`` stops at 255."""
    part = lambda shift, lead=0x80, mask=0x3F: F.lpad(F.hex(F.shiftright(code, shift).bitwiseAND(mask).bitwiseOR(lead)), 2, "0")
    octets = (
        F.when(code < 0x80, part(0, 0, 0x7F))
        .when(code < 0x800, F.concat(part(6, 0xC0, 0x1F), part(0)))
        .when(code < 0x10000, F.concat(part(12, 0xE0, 0x0F), part(6), part(0)))
        .otherwise(F.concat(part(18, 0xF0, 0x07), part(12), part(6), part(0)))
    )
    return F.decode(F.unhex(octets), "UTF-8")


def _number(ref: Column) -> Column:
    """What a numeric reference without its ``&`` stands for: Windows-1252 for 128 to 159, U+FFFD for none, empty for what HTML forbids."""
    windows = {str(k): bytes([k]).decode("cp1252", "ignore") or chr(k) for k in range(0x80, 0xA0)}

    def code(digits):
        value = F.when(ref.rlike("^#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).cast("long")
        return F.when(digits == "", 0).when(F.length(digits) > 8, 0x110000).otherwise(value)

    def character(code):
        forbidden = code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127) | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(0xFFFE) == 0xFFFE)
        return (
            F.when((code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), "\ufffd")
            .when(code.between(0x80, 0x9F), _literal_map(windows)[code.cast("string")])
            .when(forbidden, "")
            .otherwise(_utf8(code))
        )

    return bound(bound(F.regexp_replace(ref, r"^#[xX]?0*|;$", ""), code), character)


def _named(ref: Column) -> Column:
    """What a name without its ``&`` stands for: as a whole, or its longest beginning that needs no semicolon; else as it is."""
    every, old = _names()
    longest = F.least(F.length(ref) - 1, F.lit(max(map(len, old))))
    found = F.transform(F.sequence(longest, F.lit(2), F.lit(-1)), lambda n: F.concat(_find(old, F.substring(ref, F.lit(1), n)), F.substring(ref, n + 1, F.length(ref))))
    begun = F.when(F.length(ref) > 2, F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0)))
    return F.coalesce(_find(every, ref), begun, F.concat(F.lit("&"), ref))


def html_unescape(c) -> Column:
    """Every character reference resolved once, by number or by any name of HTML 5, in the JVM.

    The text is split at its references, each is resolved, and both are put together again. A text without ``&`` is
    not split.
    """
    text = col(c)
    between = F.split(text, REFERENCE, -1)
    refs = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1))
    known = F.transform(refs, lambda r: F.when(r.startswith("#"), _number(r)).otherwise(_named(r)))
    whole = F.array_join(F.zip_with(between, known, lambda t, r: F.concat(t, F.coalesce(r, F.lit("")))), "")
    return F.when(text.contains("&"), whole).otherwise(text)


def metrics_json(metrics: dict[str, Column | str], other: Column | None = None) -> Column:
    """A JSON object of metrics, without those that are null, and of further entries (a map of names to variants)."""
    pairs = [x for k, v in metrics.items() for x in (F.lit(k), col(v).cast("double").cast("variant"))]
    known = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
    return F.to_json(known if other is None else F.map_concat(known, F.map_filter(other, lambda k, _: ~k.isin(*metrics))))


def parse_metrics(c, known: tuple[str, ...]) -> Column:
    """A struct of the ``known`` metrics as doubles, null where missing or no number, and ``other``, all further entries as variants.

    Null for what is no JSON object. ``metrics_json`` of the parts gives the object back.
    """

    def read(entries):
        number = lambda k: F.try_variant_get(F.element_at(entries, k), "$", "double").alias(k)
        return F.when(entries.isNotNull(), F.struct(*(number(k) for k in known), F.map_filter(entries, lambda k, _: ~k.isin(*known)).alias("other")))

    return bound(F.from_json(col(c), "map<string,variant>"), read)


def clean_filename(c) -> Column:
    """Unescaped, blanks single, no blanks at the ends nor ``>`` in front."""
    single = F.trim(F.regexp_replace(html_unescape(c), r"\s+", " "))
    return F.trim(F.regexp_replace(single, "^[> ]+", ""))


def plan_likeness(c, words=PLAN_WORDS, sheet_re: str = SHEET, site_re: str = SITE) -> Column:
    """``plan``, ``site_only`` or ``neither``: a site plan only counts with another drawing word or a sheet number."""
    name = F.coalesce(col(c), F.lit(""))
    lower = F.lower(name)
    hit = F.lit(False)
    other = F.lit(False)
    for w in words:
        hit = hit | lower.contains(w)
        other = other if w == "plan" else other | lower.contains(w)
    sheet = name.rlike(sheet_re)
    return F.when(name.rlike(site_re) & ~sheet & ~other, "site_only").when(hit | sheet, "plan").otherwise("neither")


def extract_id(c, pattern: str, group: int = 1) -> Column:
    """The first match of ``pattern`` after unescaping, or null."""
    return F.nullif(F.regexp_extract(html_unescape(c), pattern, group), F.lit(""))


def text_path(c, images: str = "data/pages/", texts: str = "data/pagetext/") -> Column:
    """Where the text of a page image lies: the folder replaced once, the extension by ``.txt``."""
    at = F.locate(images, col(c))
    moved = F.when(at > 0, F.concat(F.substring(col(c), F.lit(1), at - 1), F.lit(texts), F.substring(col(c), at + len(images), F.length(col(c))))).otherwise(col(c))
    return F.regexp_replace(moved, r"\.[^./]*$", ".txt")


def escape_pair(c) -> Column:
    """``;`` and ``|`` as ``,`` and ``/``, so that a name can stand in a delimited list."""
    return F.translate(col(c), ";|", ",/")


def pct(num, den) -> Column:
    """``num / den`` as a percentage with one decimal; empty where ``den`` is 0 or null."""
    return F.when(F.coalesce(col(den), F.lit(0)) == 0, "").otherwise(F.format_string("%.1f%%", 100.0 * col(num) / col(den)))


def int_or_zero(c) -> Column:
    """A text as long; 0 where it is empty, null or no integer."""
    bare = F.trim(col(c).cast("string"))
    return F.coalesce(F.when(bare.rlike(r"^[+-]?[0-9]{1,18}$"), bare.try_cast("long")), F.lit(0).cast("long"))


def page_key(stem, index, base: int = 0) -> Column:
    """``stem/page_0001``: the page's index plus ``base`` with four digits."""
    return F.format_string("%s/page_%04d", col(stem), (col(index) + base).cast("int"))


def hash_frac(c, seed: int | str = 42) -> Column:
    """A seeded fraction of [0, 1] for a key: 32 bits of sha256 of ``seed:key``. The same in any engine."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), col(c).cast("string")), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967295.0)


def text_gate(c, least: int = 50, most: int = 20_000) -> Column:
    """The stripped text, cut to ``most`` characters, if it is longer than ``least``; else null."""
    bare = strip(c)
    return F.when(F.length(bare) > least, F.substring(bare, 1, most))


def strip(c) -> Column:
    """Without blanks of any kind at the ends."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def clip(c, n: int = 500) -> Column:
    return F.substring(col(c), 1, n)


def fmt3(c) -> Column:
    """Three decimals, ``NA`` for null."""
    return F.coalesce(F.when(col(c).isNotNull(), F.format_string("%.3f", col(c).cast("double"))), F.lit("NA"))


def norm(arr) -> Column:
    """Euclidean norm of an array of numbers."""
    return F.sqrt(F.aggregate(col(arr), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def l2_normalize(arr) -> Column:
    """A unit array of doubles; a zero array stays as it is."""
    n = norm(arr)
    return bound(F.when(n == 0, 1.0).otherwise(n), lambda m: F.transform(col(arr), lambda x: x.cast("double") / m))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    """Cosine of two arrays; 0 if one is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def has_ext(c, ext: str = ".pdf") -> Column:
    return F.lower(F.trim(col(c))).endswith(ext)


def storage_name(id_, name) -> Column:
    """``<id>_<safe name>``; an empty name becomes ``<id>.pdf``."""
    given = F.coalesce(F.nullif(F.trim(col(name)), F.lit("")), F.format_string("%s.pdf", col(id_).cast("string")))
    return F.concat_ws("_", col(id_).cast("string"), F.regexp_replace(given, "[^A-Za-z0-9._-]+", "_"))
