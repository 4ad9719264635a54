"""Metadata of pages as Column expressions over a few facts per page.

A kernel reads each page once and returns its meta elements as a map and a small struct
of what the document itself says; every chain of sources is then a ``coalesce`` that
Catalyst can prune, and schema.org paths are VARIANT look-ups.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns, jsonld
from ..functions.css import select_one
from ..functions.dom import trim
from ..functions.htmlparse import parse_document
from ..functions.text import error_text, prepare
from ..operators.metadata import DUBLIN, SOURCES

_FACTS = T.StructType([T.StructField("meta", T.MapType(T.StringType(), T.StringType())), *[T.StructField(n, T.StringType()) for n in ("html_title", "html_lang", "canonical", "icon", "schema", "error")]])
_ARROW = pa.struct([("meta", pa.map_(pa.string(), pa.string())), *[(n, pa.string()) for n in ("html_title", "html_lang", "canonical", "icon", "schema", "error")]])


def page_facts(html: str | None) -> dict:
    doc = parse_document(prepare(html or ""))
    meta: dict[str, str] = {}
    for n in doc.elements("meta"):
        for name in ("property", "name", "http-equiv"):
            if name in n.attrs:
                value = n.attrs[name].lower() if name == "http-equiv" else n.attrs[name]
                meta.setdefault(f"{name}={value}", trim(n.get("content")))

    def href(selector: str) -> str | None:
        n = select_one(doc, selector)
        return (trim(n.get("href")) or None) if n is not None else None

    page, title = next(iter(doc.elements("html")), None), next(iter(doc.elements("title")), None)
    data = jsonld.schema_data(doc)
    return {
        "meta": list(meta.items()),
        "html_title": (trim(title.text()) or None) if title is not None else None,
        "html_lang": (trim(page.get("lang")) or None) if page is not None else None,
        "canonical": href('link[rel="canonical"]'),
        "icon": href('link[rel="icon"]') or href('link[rel="shortcut icon"]'),
        "schema": None if data is None else json.dumps(data, ensure_ascii=False),
        "error": None,
    }


def facts_row(html: str | None) -> dict:
    """As :func:`page_facts`; a page that can't be handled gives nulls and its ``error``."""
    try:
        row = page_facts(html)
        pa.array([row], type=_ARROW)
        return row
    except Exception as e:  # noqa: BLE001: whatever a page brings about belongs to its row
        return {"error": error_text(e)}


@F.arrow_udf(_FACTS)
def facts(html: pa.Array) -> pa.Array:
    """Column function: the facts of a page's HTML."""
    return pa.array([facts_row(h) for h in html.to_pylist()], type=_ARROW)


def _schema_text(schema: Column, path: str) -> Column:
    """The first non-blank string at a path of the object, or of the objects of the list."""
    data = F.try_parse_json(schema)
    items = F.coalesce(F.try_variant_get(data, "$", "array<variant>"), F.array(data))
    found = F.transform(items, lambda x: columns.non_empty(F.try_variant_get(x, f"$.{path}", "string")))
    return F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0))


def source(spec: str, meta: Column, schema: Column) -> Column:
    """One source of a chain, as in :data:`pagemill.operators.metadata.SOURCES`; blank is null."""
    kind, name = spec.split(":", 1)
    if kind == "s":
        return _schema_text(schema, name)
    if kind == "d":
        return F.coalesce(*[F.nullif(F.try_element_at(meta, F.lit(f"name={p}{name}")), F.lit("")) for p in DUBLIN])
    key = {"p": "property", "n": "name", "h": "http-equiv"}[kind]
    return F.nullif(F.try_element_at(meta, F.lit(f"{key}={name}")), F.lit(""))


def chain(field: str, meta: Column, schema: Column) -> Column:
    return F.coalesce(*[source(s, meta, schema) for s in SOURCES[field].split()])


def page_metadata(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """``pages`` without the HTML, with the fields that are chains of plain sources.

    Titles without their site's name and authors marked in the text are the work of
    :func:`pagemill.operators.extract.extract`.  ``error`` says why a page has no facts.
    """
    rows = pages.withColumn("__facts", facts(F.col(html_col))).drop(html_col)
    meta, schema, url = F.col("__facts.meta"), F.col("__facts.schema"), F.col(url_col)
    lang = F.replace(F.coalesce(F.col("__facts.html_lang"), chain("language", meta, schema)), F.lit("_"), F.lit("-"))
    icon = F.coalesce(source("p:og:image:favicon", meta, schema), F.col("__facts.icon"), F.concat(columns.url_origin(url), F.lit("/favicon.ico")))
    return rows.withColumns(
        {
            "meta_title": chain("title", meta, schema),
            "html_title": F.col("__facts.html_title"),
            "description": chain("description", meta, schema),
            "image": chain("image", meta, schema),
            "published": chain("published", meta, schema),
            "modified": chain("modified", meta, schema),
            "author": F.coalesce(chain("author", meta, schema), _schema_text(schema, "author.name")),
            "site": F.coalesce(chain("site", meta, schema), chain("site_more", meta, schema)),
            "language": lang,
            "domain": columns.url_host(url),
            "favicon": icon,
            "canonical_url": F.coalesce(F.col("__facts.canonical"), source("p:og:url", meta, schema)),
            "keywords": columns.keywords(chain("keywords", meta, schema)),
            "error": F.col("__facts.error"),
            "content_type": F.coalesce(chain("content_type", meta, schema), source("s:@type", meta, schema)),
        }
    ).drop("__facts")
