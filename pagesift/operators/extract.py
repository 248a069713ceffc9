"""Pages from documents, and document links from HTML."""

from __future__ import annotations

import html as _html
import re

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import strip, text_gate

ANCHOR = r"(?i)DocRedirect\((\d+)\)"
NAME = r"(?i)([^<>\r\n]{1,300}?\.[A-Za-z0-9]{2,5})\s*\(\s*\d{1,2}/\d{1,2}/\d{4}\s*\)"


def extract_links(pages: DataFrame, anchor_re: str = ANCHOR, name_re: str = NAME, window: int = 1200, key="page_id", html="html", unescape: bool = True) -> DataFrame:
    """One row for each anchor: ``key, pos, doc_id, filename``.

    The name is the last match of ``name_re`` in the ``window`` characters before the anchor, cleaned; else empty.
    Match offsets are needed, so this runs as ``mapInPandas``, a page at a time.
    """
    kind = pages.schema[key].dataType.simpleString()

    def links(batches):
        import pandas as pd

        anchor, name = re.compile(anchor_re), re.compile(name_re)
        for pdf in batches:
            rows = []
            for page, text in zip(pdf[key], pdf[html]):
                text = (_html.unescape(text) if unescape else text) if isinstance(text, str) else ""
                for pos, m in enumerate(anchor.finditer(text)):
                    found = name.findall(text[max(0, m.start() - window) : m.start()])
                    last = re.sub(r"\s+", " ", found[-1]).strip().lstrip("> ").strip() if found else ""
                    rows.append((page, pos, m.group(1), last))
            yield pd.DataFrame(rows, columns=[key, "pos", "doc_id", "filename"])

    return pages.select(key, html).mapInPandas(links, f"{key} {kind}, pos int, doc_id string, filename string")


def explode_pages(docs: DataFrame, key="document_id", text="text", splitter: str = "\f", cap: int = 150, least: int = 50, most: int = 20_000) -> DataFrame:
    """Page rows of documents with extracted text: page_index, n_chars, gated text, preview, has_vector_text, status.

    ``status`` is written, short (too little text) or out_of_range (beyond ``cap``, whose text is not kept).
    """
    pages = docs.select(key, F.posexplode(F.split(text, splitter)).alias("page_index", "_raw"))
    gated = text_gate("_raw", least, most)
    inside = F.col("page_index") < cap
    return pages.select(
        key, "page_index", F.length(strip("_raw")).alias("n_chars"), F.when(inside, gated).alias("text"),
        F.substring(strip("_raw"), 1, 300).alias("preview"), gated.isNotNull().alias("has_vector_text"),
        F.when(~inside, "out_of_range").when(gated.isNotNull(), "written").otherwise("short").alias("status"),
    )


def explode_binary(docs: DataFrame, splitter, schema: str) -> DataFrame:
    """Page rows by a pluggable ``splitter(iterator of pandas frames)`` over documents with a ``content`` column."""
    return docs.mapInPandas(splitter, schema)


def extraction_report(pages: DataFrame, status="status") -> DataFrame:
    return pages.groupBy(status).agg(F.count("*").alias("pages"), F.sum("n_chars").alias("chars"))
