"""SQL names: scalar functions, ``extract_content(html, url)`` and the table function ``dom_nodes(html)``."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import dom, text
from .operators import extractors, gfm, markdown
from .operators.extract import ARROW_RESULT, RESULT, result_row
from .operators.pipeline import Options
from .plans import nodes
from .sources import web

_SCALARS = {
    "strip_html_tags": (text.strip_html_tags, T.StringType(), pa.string()),
    "decode_html_entities": (text.decode_entities, T.StringType(), pa.string()),
    "count_html_words": (text.count_words_html, T.LongType(), pa.int64()),
    "count_words": (dom.count_words, T.LongType(), pa.int64()),
    "prepare_html": (text.prepare, T.StringType(), pa.string()),
    "html_to_markdown": (markdown.to_markdown, T.StringType(), pa.string()),
    "bbcode_to_html": (extractors.bbcode_to_html, T.StringType(), pa.string()),
    "gfm_to_html": (gfm.markdown_to_html, T.StringType(), pa.string()),
}


def _scalar(function, spark_type, arrow_type):
    """A column function; null for null and for a value that the function can't handle."""

    def one(value: str | None):
        try:
            return pa.scalar(None if value is None else function(value), type=arrow_type)
        except Exception:  # noqa: BLE001: one value must not stop a job
            return pa.scalar(None, type=arrow_type)

    @F.arrow_udf(spark_type)
    def run(values: pa.Array) -> pa.Array:
        return pa.array([one(v) for v in values.to_pylist()], type=arrow_type)

    return run


#: The same functions for DataFrames: ``SCALARS["strip_html_tags"]("html")``.
SCALARS = {name: _scalar(*spec) for name, spec in _SCALARS.items()}


@F.arrow_udf(RESULT)
def extract_content(html: pa.Array, url: pa.Array) -> pa.Array:
    o = Options(separate_markdown=True)
    return pa.array([result_row(h, u, o) for h, u in zip(html.to_pylist(), url.to_pylist())], type=ARROW_RESULT)


def register(spark: SparkSession) -> None:
    """Registers all SQL names in the session."""
    for name, function in SCALARS.items():
        spark.udf.register(name, function)
    spark.udf.register("extract_content", extract_content)
    nodes.register(spark)
    web.register(spark)
