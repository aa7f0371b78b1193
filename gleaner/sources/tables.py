"""Adapters from plain tables to (doc_id, url, title, body)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def from_documents(docs: DataFrame) -> DataFrame:
    """Title: the text before the first line end (none: empty). Body: the rest. Url: the source."""
    text = F.coalesce("text", F.lit(""))
    cut = F.instr(text, "\n")
    title = F.when(cut > 0, F.substring(text, F.lit(1), cut - 1)).otherwise("")
    body = F.substring(text, cut + 1, F.length(text))
    return docs.select("doc_id", F.col("source").alias("url"), title.alias("title"), body.alias("body"))


def from_pages(pages: DataFrame) -> DataFrame:
    """Title: the first <title> element. Body: the page without its tags."""
    html = F.coalesce("html", F.lit(""))
    title = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    body = F.regexp_replace(F.regexp_replace(html, r"(?is)<title[^>]*>.*?</title>", " "), r"<[^>]*>", " ")
    return pages.select(F.col("page_id").alias("doc_id"), "url", title.alias("title"), body.alias("body"))


def spread(rows: DataFrame, *, small: int = 256 << 20) -> DataFrame:
    """Rows over all cores where the files are too few or too small for that: below ``small`` bytes of
    input, one row group may be all there is. Larger inputs keep their splits and don't shuffle."""
    spark = rows.sparkSession
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(2 * spark.sparkContext.defaultParallelism) if size < small else rows
