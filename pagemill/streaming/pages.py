"""Pages that arrive as a stream: extraction is stateless, so the batch operator runs unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.extract import extract
from ..operators.pipeline import Options

PAGES = "page_id long, url string, html string"


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def extract_stream(pages: DataFrame, options: Options | None = None) -> DataFrame:
    return extract(pages, options)


def pages_by_domain(extracted: DataFrame, time_col: str, late: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """Pages and words per domain and time window; rows later than ``late`` are left out, so state stays bounded."""
    rows = extracted.withWatermark(time_col, late)
    return rows.groupBy(F.window(time_col, window), F.col("page.domain").alias("domain")).agg(F.count("*").alias("pages"), F.sum("page.word_count").alias("words"))


def write_stream(extracted: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    out = extracted.drop("html").writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()
