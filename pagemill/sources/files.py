"""Pages from files, and results to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns


def read_html_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: path, html.  A file is one value; the reader splits work by files."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))


def read_pages(spark: SparkSession, path: str, columns_: tuple[str, ...] = ("page_id", "url", "html"), partitions: int | None = None) -> DataFrame:
    """Pages from Parquet, only the columns asked for; ``partitions`` spreads few input splits over more tasks."""
    rows = spark.read.parquet(path).select(*columns_)
    return rows.repartition(partitions) if partitions else rows


def result_json(page: Column, pretty: bool = False) -> Column:
    """A result as JSON: absent fields and empty keywords are left out, ``schema_org_data`` is always there, as JSON."""
    plain = F.to_json(page.withField("schema_org_data", F.lit(None).cast("string")).withField("keywords", F.when(F.size(page["keywords"]) > 0, page["keywords"])), {"pretty": str(pretty).lower()})
    data = F.coalesce(page["schema_org_data"], F.lit("null"))
    return F.concat(F.regexp_replace(plain, r"\s*\}\z", ""), F.lit(',\n  "schema_org_data" : ' if pretty else ',"schema_org_data":'), data, F.lit("\n}" if pretty else "}"))


def result_text(page: Column) -> Column:
    """A result as plain text."""
    return columns.trim(columns.decode_entities(columns.strip_tags(page["content"])))


def result_markdown(page: Column) -> Column:
    return F.coalesce(page["content_markdown"], page["content"])


def write_results(extracted: DataFrame, path: str, form: str = "json", key: str = "page_id") -> None:
    """Writes (key, value) rows, as ``json``, ``html``, ``text`` or ``markdown``, to Parquet."""
    value = {"json": result_json, "html": lambda p: p["content"], "text": result_text, "markdown": result_markdown}[form](F.col("page"))
    extracted.select(key, value.alias("value")).write.mode("overwrite").parquet(path)
