"""Pages as rows of nodes, and the page operators that are joins, windows and aggregates over them.

``nodes(page, node_id, end_id, parent_id, depth, child_idx, kind, tag, attrs, own_text)``: ids count in
document order; ``end_id`` is the last id below a node, so d is below a if and only if
``a.node_id < d.node_id <= a.end_id`` on the same page.  A page that can't be parsed has one row
of kind "error" with the reason as its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions import columns
from ..functions.dom import COMMENT, DOCUMENT, ELEMENT, TEXT, Node
from ..functions.htmlparse import parse_document
from ..functions.text import error_text, prepare

SCHEMA = "page long, node_id int, end_id int, parent_id int, depth int, child_idx int, kind string, tag string, attrs map<string,string>, own_text string"
_KINDS = {DOCUMENT: "document", ELEMENT: "element", TEXT: "text", COMMENT: "comment"}
_ARROW = pa.schema([("page", pa.int64()), ("node_id", pa.int32()), ("end_id", pa.int32()), ("parent_id", pa.int32()), ("depth", pa.int32()), ("child_idx", pa.int32()), ("kind", pa.string()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("own_text", pa.string())])


def node_rows(html: str | None) -> list[tuple]:
    """Rows of one page, without the page's id, in document order."""
    try:
        return _rows(parse_document(prepare(html or "")))
    except Exception as e:  # noqa: BLE001: whatever a page brings about belongs to its rows
        return [(0, 0, None, 0, 0, "error", None, None, error_text(e))]


def _rows(doc: Node) -> list[tuple]:
    rows: list[list] = []

    def add(n: Node, parent: int | None, depth: int, idx: int) -> None:
        me = len(rows)
        rows.append([me, me, parent, depth, idx, _KINDS[n.kind], n.tag or None, list(n.attrs.items()) if n.kind == ELEMENT else None, n.data if n.kind in (TEXT, COMMENT) else None])
        todo = [iter(enumerate(n.children))]
        path = [me]
        while todo:
            step = next(todo[-1], None)
            if step is None:
                todo.pop()
                rows[path.pop()][1] = len(rows) - 1
                continue
            k, c = step
            own = len(rows)
            rows.append([own, own, path[-1], len(path) + depth, k, _KINDS[c.kind], c.tag or None, list(c.attrs.items()) if c.kind == ELEMENT else None, c.data if c.kind in (TEXT, COMMENT) else None])
            todo.append(iter(enumerate(c.children)))
            path.append(own)

    add(doc, None, 0, 0)
    return [tuple(r) for r in rows]


def dom_nodes(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """The node table of ``pages``; null HTML is an empty page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for page, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += [(page, *r) for r in node_rows(html)]
                if len(rows) > 50_000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    return pages.select(F.col(id_col).cast("long"), F.col(html_col).cast("string")).mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_ARROW)], schema=_ARROW)


@udtf(returnType=SCHEMA.removeprefix("page long, "))
class DomNodes:
    """``SELECT * FROM pages, LATERAL dom_nodes(html)``."""

    def eval(self, html: str):
        for r in node_rows(html):
            yield (*r[:7], dict(r[7]) if r[7] is not None else None, r[8])


# -- operators over the node table -------------------------------------


def attr(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def elements(nodes: DataFrame, *tags: str) -> DataFrame:
    rows = nodes.where("kind = 'element'")
    return rows.where(F.col("tag").isin(*tags)) if tags else rows


def merged(left: DataFrame, right: DataFrame, on: Column | list[str], how: str = "inner") -> DataFrame:
    """A join by page, of sides that both grow with the pages.

    Stored nodes repeat so much that a few MB of Parquet hold GBs of rows; by the size of the files
    Spark would send one side through the driver to all executors.
    """
    return left.join(right.hint("merge"), on, how)


def within(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Pairs (o, i) of nodes where i is below o: an interval join inside each page."""
    o, i = outer.alias("o"), inner.alias("i")
    return merged(o, i, (F.col("o.page") == F.col("i.page")) & (F.col("i.node_id") > F.col("o.node_id")) & (F.col("i.node_id") <= F.col("o.end_id")))


def has_below(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """Nodes of ``outer`` with a node of ``inner`` below: a semi join."""
    o, i = outer.alias("o"), inner.select("page", "node_id").alias("i")
    return merged(o, i, (F.col("o.page") == F.col("i.page")) & (F.col("i.node_id") > F.col("o.node_id")) & (F.col("i.node_id") <= F.col("o.end_id")), "left_semi")


def not_inside(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Nodes of ``inner`` that are below no node of ``outer``: an anti join."""
    o, i = outer.select("page", "node_id", "end_id").alias("o"), inner.alias("i")
    return merged(i, o, (F.col("o.page") == F.col("i.page")) & (F.col("i.node_id") > F.col("o.node_id")) & (F.col("i.node_id") <= F.col("o.end_id")), "left_anti")


def text_of(nodes: DataFrame, outer: DataFrame) -> DataFrame:
    """page, node_id, text: the text below each node of ``outer``, in document order."""
    pairs = within(nodes.where("kind = 'text'").select("page", "node_id", "own_text"), outer.select("page", "node_id", "end_id"))
    parts = pairs.groupBy(F.col("o.page").alias("page"), F.col("o.node_id").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("i.node_id").alias("n"), F.col("i.own_text").alias("t")))).alias("parts"))
    texts = parts.select("page", "node_id", F.array_join(F.transform("parts", lambda p: p["t"]), "").alias("text"))
    return merged(outer.select("page", "node_id"), texts, ["page", "node_id"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def link_density(nodes: DataFrame, outer: DataFrame) -> DataFrame:
    """page, node_id, density: bytes of link texts over bytes of the text, both trimmed."""
    size = lambda c: F.octet_length(columns.trim(F.col(c)))
    links = elements(nodes, "a")
    link_text = text_of(nodes, links).withColumnRenamed("text", "link_text")
    below = within(link_text.select("page", "node_id", "link_text"), outer.select("page", "node_id", "end_id"))
    sums = below.groupBy(F.col("o.page").alias("page"), F.col("o.node_id").alias("node_id")).agg(F.sum(size("i.link_text")).alias("linked"))
    rows = merged(text_of(nodes, outer), sums, ["page", "node_id"], "left")
    return rows.select("page", "node_id", F.when(size("text") > 0, F.coalesce("linked", F.lit(0)) / size("text")).otherwise(0.0).alias("density"))


def tag_counts(nodes: DataFrame, outer: DataFrame, *tags: str) -> DataFrame:
    """page, node_id and one count per tag of the elements below each node of ``outer``."""
    pairs = within(elements(nodes, *tags).select("page", "node_id", "tag"), outer.select("page", "node_id", "end_id"))
    counts = pairs.groupBy(F.col("o.page").alias("page"), F.col("o.node_id").alias("node_id")).agg(*[F.count_if(F.col("i.tag") == t).alias(t) for t in tags])
    return merged(outer.select("page", "node_id"), counts, ["page", "node_id"], "left").na.fill(0)


def siblings(nodes: DataFrame) -> DataFrame:
    """Elements with the ids of the elements before and after them under the same parent."""
    order = Window.partitionBy("page", "parent_id").orderBy("child_idx")
    rows = elements(nodes)
    return rows.withColumn("previous", F.lag("node_id").over(order)).withColumn("following", F.lead("node_id").over(order)).withColumn("from_start", F.row_number().over(order)).withColumn("from_end", F.count("*").over(Window.partitionBy("page", "parent_id")) - F.col("from_start") + 1)


def hidden(nodes: DataFrame) -> DataFrame:
    """Elements that are hidden by style, attribute or class."""
    return elements(nodes).where(columns.is_hidden(attr("style"), attr("class"), attr("hidden"), attr("aria-hidden"), attr("inert")))


def best_images(nodes: DataFrame) -> DataFrame:
    """Of images of a page with the same alt text, the best: larger, with a srcset, with a longer source; then the earlier."""
    number = lambda name: F.coalesce(attr(name).try_cast("long"), F.lit(0))
    w, h = number("width"), number("height")
    size = F.when((w > 0) & (h > 0), w * h).otherwise(w + h)
    quality = size + F.when(attr("srcset").isNotNull(), 10_000).otherwise(0) + F.coalesce(F.octet_length(attr("src")), F.lit(0))
    images = elements(nodes, "img").withColumn("alt", attr("alt")).withColumn("quality", quality)
    rank = F.row_number().over(Window.partitionBy("page", "alt").orderBy(F.col("quality").desc(), "node_id"))
    named = images.where("alt is not null and alt <> ''").withColumn("rank", rank).where("rank = 1").drop("rank")
    return named.unionByName(images.where("alt is null or alt = ''"))


def metadata_blocks(nodes: DataFrame) -> DataFrame:
    """page, node_id: of the three elements after a page's first h1, the first short one that has a date."""
    first = elements(nodes, "h1").groupBy("page").agg(F.min_by(F.struct("parent_id", "child_idx"), "node_id").alias("h"))
    after = merged(elements(nodes).alias("n"), first.alias("f"), (F.col("n.page") == F.col("f.page")) & (F.col("n.parent_id") == F.col("f.h.parent_id")) & (F.col("n.child_idx") > F.col("f.h.child_idx"))).select("n.*")
    near = after.withColumn("k", F.row_number().over(Window.partitionBy("page").orderBy("child_idx"))).where("k <= 3")
    texts = merged(text_of(nodes, near), near.select("page", "node_id", "k"), ["page", "node_id"])
    date = r"(?i)(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\w*\s+\d{1,2},?\s+\d{4}|\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4}"
    short = columns.trim(F.col("text"))
    found = texts.where((short != "") & (F.octet_length(short) < 300) & F.regexp_like("text", F.lit(date)))
    return found.groupBy("page").agg(F.min_by("node_id", "k").alias("node_id"))


def streamed_segments(nodes: DataFrame) -> DataFrame:
    """page, template_id, segment_id: templates and the segments that scripts would move there, joined by their ids."""
    texts = text_of(nodes, elements(nodes, "script").where(attr("src").isNull()))
    calls = texts.select("page", F.explode(F.regexp_extract_all("text", F.lit(r"\$RC\(([^)]*)\)"), F.lit(1))).alias("args"))
    part = lambda k: F.regexp_replace(columns.trim(F.split_part("args", F.lit(","), F.lit(k))), '^"+|"+$', "")
    calls = calls.select("page", part(1).alias("boundary"), part(2).alias("segment"))
    named = elements(nodes).where(attr("id").isNotNull()).select("page", "tag", attr("id").alias("name"), "node_id")
    holes = named.where("tag = 'template'").select("page", F.col("name").alias("boundary"), F.col("node_id").alias("template_id"))
    parts = named.select("page", F.col("name").alias("segment"), F.col("node_id").alias("segment_id"))
    return merged(merged(calls, holes, ["page", "boundary"]), parts, ["page", "segment"]).select("page", "template_id", "segment_id")


def register(spark: SparkSession) -> None:
    spark.udtf.register("dom_nodes", DomNodes)
