"""WARC derivatives: metadata and plain-text conversion records made from response records.

For each response record two records are made that refer to it: ``metadata`` (title, outlinks, HTTP headers of the
source) and ``conversion`` (the visible text). Both keep the source's target URI, date, record id and payload
digest, and carry a digest of their own block. Records are rows first; ``write`` puts them into WARC files.
"""

from __future__ import annotations

import gzip
import html
import re
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import arrow_udf

from ..plans.storage import materialize
from .common import ROWS, as_bytes

VERSION = "WARC/1.1"
#: WARC-Date of pages that have no date of their own.
DATE = "1970-01-01T00:00:00Z"
RECORD = "page_id long, record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, payload_digest string, block_digest string, content_length long, block string"

WS = rb"\x20\x09-\x0D"
#: A start tag: its name and the rest up to the first > that stands in no quoted value. Nothing is tried twice (``++``).
START = rb"<([A-Za-z][^" + WS + rb"/>]*+)((?:[^>=]++|=[" + WS + rb"]*+(?:\x22[^\x22]*+\x22|'[^']*+')|=)*+)>"
#: An end tag, a declaration or an instruction.
OTHER = rb"<(?:/([A-Za-z][^" + WS + rb"/>]*+)|[/!?])[^>]*+>"
#: An attribute: its name and, if it has one, its value in double or single quotes or bare.
ATTRIBUTE = rb"([^" + WS + rb"/>=]++)(?:[" + WS + rb"]*+=[" + WS + rb"]*+(\x22[^\x22]*+\x22|'[^']*+'|[^" + WS + rb">]*+))?"
#: Tags that end a line.
BREAKS = frozenset(b"br p div h1 h2 h3 h4 h5 h6 li ul ol tr table nav article section header footer aside main title blockquote pre hr body html".split())
#: Elements whose content is no markup, and elements that a browser does not show.
RAW = (b"script", b"style")
UNSEEN = (b"head", b"noscript", b"template")
#: A character reference; one without its semicolon stays as it is.
REFERENCE = rb"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"
PARTS = "title string, links array<string>, text string"


def record_id(kind: str, *parts: Column) -> Column:
    """A name-based urn:uuid, the same for the same page and kind."""
    h = F.md5(F.concat_ws("\x1f", F.lit(kind), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records from ``page_id, url, html``: ids, headers and digests; a null page has an empty payload."""
    body = F.coalesce("html", F.lit(""))
    charset = F.lower(F.regexp_extract(body, r"(?i)<meta[^>]*charset=[\x22']?([A-Za-z0-9_-]+)", 1))
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html"), F.when(charset != "", F.concat(F.lit("; charset="), charset)).otherwise(""), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n"))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        record_id("response", F.col("page_id"), F.col("url")).alias("record_id"),
        F.coalesce("url", F.lit("")).alias("target_uri"),
        F.lit(date).alias("warc_date"),
        headers.alias("http_headers"),
        digest(body).alias("payload_digest"),
        body.alias("payload"),
    )


def unescape(data: bytes) -> bytes:
    """Resolve all named and numeric character references once; a no-break space written by name is a blank."""
    return _REFERENCE.sub(lambda m: b" " if m[0] == b"&nbsp;" else html.unescape(m[0].decode()).encode("utf-8", "replace"), data) if b"&" in data else data


_START, _OTHER, _ATTRIBUTE, _REFERENCE = (re.compile(p) for p in (START, OTHER, ATTRIBUTE, REFERENCE))
_BLANKS = bytes(32 if c in b"\t\n\x0b\x0c\r" else c for c in range(256))
_CLOSES = {name: re.compile(rb"</" + name + rb"(?=[" + WS + rb"/>])", re.I) for name in (*RAW, *UNSEEN, b"title", b"body")}
_HEAD_ENDS = re.compile(rb"</head(?=[" + WS + rb"/>])|<body(?=[" + WS + rb"/>])", re.I)


def href(attributes: bytes) -> bytes | None:
    """The value of the first attribute ``href``, None without one."""
    for name, value in _ATTRIBUTE.findall(attributes):
        if name.lower() == b"href":
            return value[1:-1] if value[:1] in (b'"', b"'") else value
    return None


class Walk:
    """One pass over a page that only moves forward: its first title, the href values of its anchors, and its shown text.

    Tags end at the first ``>`` outside of quoted values. Comments, scripts and styles are skipped to their end, or to
    the end of the page where they have none; head, noscript and template are not shown, and template has no anchors.
    What follows a ``<`` without its ``>`` is dropped, as a browser does.
    """

    def __init__(self, page: bytes):
        self.page, self.title, self.links, self.text = page, None, [], []
        self.missing: set = set()  # ends that were sought from some place on and are not there
        self.walk()

    def find(self, pattern: re.Pattern, at: int) -> re.Match | None:
        """The next match; a pattern that has none is not sought again."""
        if pattern in self.missing:
            return None
        found = pattern.search(self.page, at)
        if found is None:
            self.missing.add(pattern)
        return found

    def walk(self) -> None:
        page, text, at, hidden = self.page, self.text, 0, None
        while True:
            start = page.find(b"<", at)
            if not hidden:
                text.append(page[at : start if start >= 0 else None].translate(_BLANKS))
            if start < 0:
                return
            if page.startswith(b"<!--", start):
                end = page.find(b"-->", start + 4)
                if end < 0:
                    return
                text.append(b" ")
                at = end + 3
                continue
            follows = page[start + 1 : start + 2]
            tag = _START.match(page, start) if follows.isalpha() else _OTHER.match(page, start) if follows in (b"/", b"!", b"?") and follows else None
            if tag is None:
                if follows.isalpha() or follows in (b"/", b"!", b"?") and follows:
                    return
                if not hidden:
                    text.append(b"<")
                at = start + 1
                continue
            at, name = tag.end(), (tag[1] or b"").lower()
            opens = tag.re is _START
            if hidden:
                if not opens and name == hidden or hidden == b"head" and name == b"body":
                    hidden = None
                    text.append(b" ")
                elif opens and name in RAW:
                    at = self.skip(name, at)
                elif opens and name == b"title":
                    self.take_title(at)
                elif opens and name == b"a" and hidden != b"template":
                    self.take_link(tag[2])
                if at < 0:
                    return
                if hidden or name != b"body":
                    continue
            if name in BREAKS:
                text.append(b"\n")
            if not opens:
                continue
            if name in RAW:
                text.append(b" ")
                at = self.skip(name, at)
                if at < 0:
                    return
            elif name in UNSEEN:
                if name != b"head" or self.find(_HEAD_ENDS, at):
                    text.append(b" ")
                    hidden = name
            elif name == b"a":
                self.take_link(tag[2])
            elif name == b"title":
                self.take_title(at)

    def skip(self, name: bytes, at: int) -> int:
        """The place behind the end tag of a raw element, -1 without one."""
        close = self.find(_CLOSES[name], at)
        end = self.page.find(b">", close.end()) if close else -1
        return end + 1 if end >= 0 else -1

    def take_title(self, at: int) -> None:
        close = self.find(_CLOSES[b"title"], at) if self.title is None else None
        if close:
            self.title = self.page[at : close.start()]

    def take_link(self, attributes: bytes) -> None:
        found = href(attributes) if b"=" in attributes else None
        if found is not None:
            self.links.append(unescape(found))


def _shown(walk: Walk) -> bytes:
    text = unescape(b"".join(walk.text))
    lines = (b" ".join(x for x in line.replace(b"\t", b" ").split(b" ") if x) for line in text.split(b"\n"))
    return b"\n".join(x for x in lines if x)


def _titled(walk: Walk) -> bytes:
    return re.sub(rb"[\x20\x09-\x0D]+", b" ", unescape(walk.title)) if walk.title else b""


def visible_text(page: bytes) -> bytes:
    """The text of a page: hidden parts and tags removed, block tags as line ends, blanks single, no empty lines."""
    return _shown(Walk(page))


def links(page: bytes) -> list[bytes]:
    """The href values of a page's anchors in order."""
    return Walk(page).links


def title(page: bytes) -> bytes:
    """The first title of a page, blanks single; empty if it has none."""
    return _titled(Walk(page))


def parts(page: Column | str) -> Column:
    """Title, outlinks and visible text of a column of pages; null pages have none."""

    @arrow_udf(PARTS)
    def take(column):
        import pyarrow as pa

        def some(pages):
            strings = lambda values: pa.array(values, pa.binary()).cast(pa.string())
            walks = [Walk(p) for p in pages]
            found = [w.links for w in walks]
            sizes = pa.array([0, *accumulate(map(len, found))], pa.int32())
            flat = strings([x for each in found for x in each])
            return pa.StructArray.from_arrays([strings([_titled(w) for w in walks]), pa.ListArray.from_arrays(sizes, flat), strings([_shown(w) for w in walks])], names=["title", "links", "text"])

        pieces = (column.slice(i, 500) for i in range(0, max(1, len(column)), 500))  # lists of whole pages stay short
        return pa.concat_arrays([some([p or b"" for p in as_bytes(piece)]) for piece in pieces])

    return take.asNondeterministic()(page)  # so that no rewrite evaluates it more than once


def derivatives(source: DataFrame) -> DataFrame:
    """Two rows for each row of ``responses``: its metadata record and its conversion record, linked by ``refers_to``.

    Columns as in ``RECORD``. The metadata block has the fields title, outlink (one for each anchor), source headers
    and source digest. A page with no text has an empty conversion block. Repeated pages give repeated records.
    """
    made = source.withColumn("_parts", parts("payload"))
    fields = F.concat(
        F.lit("title: "), F.col("_parts.title"), F.lit("\r\n"),
        F.array_join(F.transform("_parts.links", lambda x: F.concat(F.lit("outlink: "), F.regexp_replace(x, r"[\r\n]+", " "), F.lit("\r\n"))), ""),
        F.array_join(F.transform(F.filter(F.split("http_headers", "\r\n"), lambda x: x != ""), lambda x: F.concat(F.lit("source-header: "), x, F.lit("\r\n"))), ""),
        F.lit("source-digest: "), F.col("payload_digest"), F.lit("\r\n"),
    )
    both = F.array(
        F.struct(F.lit("metadata").alias("kind"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("kind"), F.lit("text/plain").alias("content_type"), F.col("_parts.text").alias("block")),
    )
    rows = made.select("page_id", "record_id", "target_uri", "warc_date", "payload_digest", F.explode(both).alias("r"))
    own = F.when(F.col("r.kind") == "metadata", record_id("metadata", F.col("record_id"))).otherwise(record_id("conversion", F.col("record_id")))
    return rows.select(
        "page_id",
        F.col("r.kind").alias("record_type"),
        own.alias("record_id"),
        F.col("record_id").alias("refers_to"),
        "target_uri",
        "warc_date",
        F.col("r.content_type").alias("content_type"),
        "payload_digest",
        digest(F.col("r.block")).alias("block_digest"),
        F.octet_length("r.block").cast("long").alias("content_length"),
        F.col("r.block").alias("block"),
    )


def report(pages: DataFrame) -> DataFrame:
    """The derivative records of all pages."""
    return derivatives(responses(pages))


def write(records: DataFrame, path: str, per_file: int = 50_000, bytes_per_file: int = 256 << 20) -> None:
    """Write records as WARC files of about ``per_file`` records or ``bytes_per_file`` bytes, whichever is less, each behind a ``warcinfo`` record.

    The records are written once, then dealt out; a file's ``warcinfo`` id is made from its number and its first record.

    Files are not compressed: compressed WARC needs a gzip member for each record, which Spark's text sink does not
    write. Header values have line ends replaced by blanks. Lines of the header end in CR LF as the format asks.
    """
    names = (("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"), ("WARC-Payload-Digest", "payload_digest"), ("WARC-Block-Digest", "block_digest"), ("X-Page-ID", "page_id"), ("Content-Type", "content_type"), ("Content-Length", "content_length"))
    lines = [F.concat(F.lit(f"{n}: "), F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\r\n]+", " "), F.lit("\r\n")) for n, c in names]
    whole = F.concat(F.lit(f"{VERSION}\r\n"), *lines, F.lit("\r\n"), F.col("block"))
    made = materialize(records.select(whole.alias("value"), F.octet_length(whole).cast("long").alias("n")), "records", batch=ROWS)
    size = made.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("bytes")).first()
    files = max(1, -(-size["rows"] // per_file), -(-size["bytes"] // bytes_per_file))

    def with_info(batches):
        import uuid

        import pyarrow as pa

        from pyspark import TaskContext

        first = next(batches, None)
        name = f"{TaskContext.get().partitionId()}:{first.column(0)[0].as_py() if first is not None and first.num_rows else ''}"
        block = "format: WARC File Format 1.1\r\n"
        info = f"{VERSION}\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n{block}"
        yield pa.RecordBatch.from_pydict({"value": [info]})
        if first is not None:
            yield first
        yield from batches

    made.select("value").repartition(files).mapInArrow(with_info, "value string").write.option("lineSep", "\r\n\r\n").text(path)


def parse(data: bytes) -> list[dict]:
    """The records of one WARC file, gzipped or not."""
    order = ("X-Page-ID", "WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "WARC-Date", "Content-Type", "WARC-Payload-Digest", "WARC-Block-Digest")
    names = ("page_id", "record_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "payload_digest", "block_digest")
    data, at, rows = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data, 0, []
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
        n = int(head["Content-Length"])
        rows.append({k: head.get(h) for k, h in zip(names, order)} | {"content_length": n, "block": data[end + 4 : end + 4 + n].decode()})
        at = end + 8 + n
    return rows


def read(spark: SparkSession, path: str) -> DataFrame:
    """Read the derivative records of WARC files back by their Content-Length; a file is read whole, so ``write`` bounds its records."""

    def records(batches):
        import pyarrow as pa

        kinds = pa.schema([(n, pa.int64() if k == "long" else pa.string()) for n, k in (x.split() for x in RECORD.split(", "))])
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows = [r | {"page_id": int(r["page_id"]) if r["page_id"] else None} for r in parse(data) if r["record_type"] != "warcinfo"]
                yield from pa.Table.from_pylist(rows, schema=kinds).to_batches(max_chunksize=2000)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(records, RECORD)
