"""Extraction of pages: one page as a function, tables of pages as DataFrames."""

from __future__ import annotations

import json
import sys
import time
from collections.abc import Iterator, Mapping
from dataclasses import asdict, replace
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import jsonld
from ..functions.dom import Node
from ..functions.text import count_words_html, error_text, non_empty, prepare
from . import extractors
from .markdown import to_markdown
from .metadata import Metadata, clean_title, extract_metadata, meta_tags
from .pipeline import Options, Page, Pass, extract_content
from .standardize import sanitize

#: Some walks go down recursively; pages nest far deeper than Python's default limit.
sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))

_TAG = T.StructType([T.StructField(n, T.StringType()) for n in ("name", "property", "content")])
_REMOVAL = T.StructType([T.StructField(n, T.StringType()) for n in ("step", "selector", "reason", "text")])
_TEXTS = "title description domain favicon image language published modified author site canonical_url content_type".split()
#: The result of a page.  ``schema_org_data`` is JSON; ``meta_tags`` and ``debug`` are null unless debugging;
#: ``error`` says why a page has no result, and is null where it has one.
RESULT = T.StructType(
    [
        T.StructField("content", T.StringType()),
        T.StructField("content_markdown", T.StringType()),
        *[T.StructField(n, T.StringType()) for n in _TEXTS],
        T.StructField("keywords", T.ArrayType(T.StringType())),
        T.StructField("word_count", T.LongType()),
        T.StructField("parse_time_ms", T.LongType()),
        T.StructField("schema_org_data", T.StringType()),
        T.StructField("extractor_type", T.StringType()),
        T.StructField("meta_tags", T.ArrayType(_TAG)),
        T.StructField("debug", T.StructType([T.StructField("content_selector", T.StringType()), T.StructField("removals", T.ArrayType(_REMOVAL))])),
        T.StructField("error", T.StringType()),
    ]
)


def _override(meta: Metadata, e: extractors.Extract, kind: str) -> None:
    """What a site's extractor knows better: Substack only fills gaps, BBCode knows title and author."""
    for name in ("title", "author", "site"):
        value = non_empty(getattr(e, name))
        if value is not None and (kind != "substack" or getattr(meta, name) is None):
            setattr(meta, name, clean_title(value, "") if name == "title" else value)
    for name in ("published", "image", "description"):
        if getattr(meta, name) is None:
            setattr(meta, name, non_empty(getattr(e, name)))


_LABELS = {"bbcode": "div[data-partnereventstore]", "substack": "feedCommentBody"}


def _by_site(doc: Node, o: Options, meta: Metadata, payloads: Mapping[str, str]) -> tuple[str, Pass] | None:
    def tries() -> Iterator[tuple[str, extractors.Extract | None]]:
        yield "bbcode", extractors.bbcode(doc)
        yield "substack", extractors.substack(doc, o.url)
        found = extractors.site_extract(doc, o.url, o.include_replies, payloads)
        if found is not None:
            yield found

    for kind, e in tries():
        if e is None:
            continue
        _override(meta, e, kind)
        words = count_words_html(e.content)
        if words:
            return kind, Pass(sanitize(e.content, o.url), words, _LABELS.get(kind, "site-extractor"))
    return None


def extract_page(html: str | None, url: str | None = None, options: Options | None = None, payloads: Mapping[str, str] | None = None) -> dict[str, Any]:
    """The result of one page, as a dict with the fields of :data:`RESULT`; null HTML is an empty page."""
    began = time.perf_counter()
    o = replace(options or Options(), url=url if url is not None else (options.url if options else None))
    page = Page(prepare(html or ""))
    schema = jsonld.schema_data(page.parsed)
    meta = extract_metadata(page.parsed, o.url, schema)
    found = _by_site(page.parsed, o, meta, payloads or {})
    kind, best = found if found is not None else (None, extract_content(page, o, jsonld.article_text(schema)))
    markdown = to_markdown(best.content) if o.markdown or o.separate_markdown else None
    return {
        "content": markdown if o.markdown and markdown is not None else best.content,
        "content_markdown": markdown,
        **asdict(meta),
        "word_count": best.words,
        "parse_time_ms": int((time.perf_counter() - began) * 1000),
        "schema_org_data": None if schema is None else json.dumps(schema, ensure_ascii=False),
        "extractor_type": kind,
        "meta_tags": meta_tags(page.parsed) if o.debug else None,
        "debug": {"content_selector": best.selector, "removals": best.removals} if o.debug else None,
        "error": None,
    }


def result_row(html: str | None, url: str | None = None, options: Options | None = None, payloads: Mapping[str, str] | None = None) -> dict[str, Any]:
    """As :func:`extract_page`; a page that can't be handled gives nulls and its ``error``, so that it stops no job."""
    try:
        row = extract_page(html, url, options, payloads)
        pa.array([row], type=ARROW_RESULT)
        return row
    except Exception as e:  # noqa: BLE001: whatever a page brings about belongs to its row
        return dict.fromkeys(RESULT.fieldNames()) | {"error": error_text(e)}


def extract(pages: DataFrame, options: Options | None = None, html_col: str = "html", url_col: str | None = "url", api_payloads: DataFrame | None = None) -> DataFrame:
    """``pages`` with a struct column ``page`` (:data:`RESULT`); other columns stay.

    A narrow transformation: pages never meet, so filter and prune before it, and repartition first if
    there are few input splits.  ``api_payloads(url, body)`` holds API answers fetched beforehand; each
    page gets those whose address its own address asks for.
    """
    o = options or Options()
    row = pages.withColumn("__html", F.col(html_col).cast("string")).withColumn("__url", F.col(url_col).cast("string") if url_col else F.lit(o.url).cast("string"))
    if api_payloads is not None:
        row = _with_payloads(row, api_payloads)
    else:
        row = row.withColumn("__payloads", F.lit(None).cast("map<string,string>"))

    @F.arrow_udf(RESULT)
    def run(html: pa.Array, url: pa.Array, payloads: pa.Array) -> pa.Array:
        rows = [result_row(h, u, o, dict(p or ())) for h, u, p in zip(html.to_pylist(), url.to_pylist(), payloads.to_pylist())]
        return pa.array(rows, type=ARROW_RESULT)

    return row.withColumn("page", run("__html", "__url", "__payloads")).drop("__html", "__url", "__payloads")


def _arrow(t: T.DataType) -> pa.DataType:
    if isinstance(t, T.StructType):
        return pa.struct([pa.field(f.name, _arrow(f.dataType)) for f in t.fields])
    if isinstance(t, T.ArrayType):
        return pa.list_(_arrow(t.elementType))
    return pa.int64() if isinstance(t, T.LongType) else pa.string()


ARROW_RESULT = _arrow(RESULT)


def _with_payloads(rows: DataFrame, api_payloads: DataFrame) -> DataFrame:
    """Adds the API answers that a page's address asks for, joined by address."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def wanted(url: pa.Array) -> pa.Array:
        return pa.array([extractors.api_urls(u) for u in url.to_pylist()], type=pa.list_(pa.string()))

    asks = rows.select("__url").where("__url is not null").distinct().select("__url", F.explode(wanted("__url")).alias("__ask"))
    answers = asks.join(api_payloads.select(F.col("url").alias("__ask"), F.col("body").alias("__body")), "__ask")
    maps = answers.groupBy(F.col("__url").alias("__page_url")).agg(F.map_from_entries(F.collect_list(F.struct("__ask", "__body"))).alias("__payloads"))
    return rows.join(maps, F.col("__url") == F.col("__page_url"), "left").drop("__page_url")
