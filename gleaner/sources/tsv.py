"""Tab-separated corpora without header: doc_id, url, title, text.

Lines are split at tabs only; quotes mean nothing. Fields beyond the fourth belong to the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_ID = (1 << 32) - 1
#: What Python's str.strip takes away.
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def parse_records(rows: DataFrame, column: str = "value") -> DataFrame:
    """(doc_id, url, title, body). Rows with fewer than four fields are skipped; an id that isn't an
    unsigned 32-bit number fails the whole read."""
    fields = F.split(F.col(column), "\t", 4)
    parsed = rows.select(fields.alias("f")).where(F.size("f") >= 4)
    raw = F.col("f")[0]
    number = F.when(raw.rlike("^[0-9]{1,10}$"), raw.cast("long"))
    bad = F.raise_error(F.concat(F.lit("invalid document id: "), raw)).cast("long")
    doc_id = F.when(number <= MOST_ID, number).otherwise(bad)
    return parsed.select(doc_id.alias("doc_id"), F.col("f")[1].alias("url"), F.col("f")[2].alias("title"), F.col("f")[3].alias("body"))


def load(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """The corpus; ``limit`` counts accepted rows, 0 means all."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    docs = parse_records(lines(spark, path))
    return docs.limit(limit) if limit else docs


def embedding_texts(rows: DataFrame, column: str = "value") -> DataFrame:
    """(doc_id, text) for an encoder: rows are stripped, two fields are enough, rows with a bad id are
    skipped; with four fields or more the text is title and body, else all after the id."""
    # Only the ends are looked at, and the text is one field: a pattern would be tried at every blank of it.
    fields = F.split(F.btrim(F.col(column), F.lit(BLANKS)), "\t", 4)
    parsed = rows.select(fields.alias("f")).where(F.size("f") >= 2)
    parsed = parsed.withColumn("doc_id", F.expr("try_cast(trim(f[0]) AS bigint)")).where("doc_id BETWEEN 0 AND 4294967295")
    titled = F.concat_ws(" ", F.get("f", F.lit(2)), F.replace(F.get("f", F.lit(3)), F.lit("\t"), F.lit(" ")))
    rest = F.array_join(F.slice("f", 2, F.size("f")), " ")
    return parsed.select("doc_id", document_text(F.when(F.size("f") >= 4, titled).otherwise(rest)).alias("text"))


def document_text(text: Column) -> Column:
    return F.concat(F.lit("search_document: "), text)


def query_text(query: str) -> str:
    return f"search_query: {query}"


def strip_id_prefix(rows: DataFrame, column: str = "value") -> DataFrame:
    """Drops the first character of every line's first field."""
    return rows.withColumn(column, F.substring(F.col(column), F.lit(2), F.length(column)))


def load_queries(spark: SparkSession, path: str) -> list[str]:
    """One query a line; blank lines don't count; none at all is an error."""
    trimmed = F.trim(F.regexp_replace("value", r"\r", ""))
    found = [r[0] for r in spark.read.text(path).select(trimmed.alias("q")).where("q <> ''").collect()]
    if not found:
        raise ValueError("no queries found")
    return found


def write_queries(spark: SparkSession, path: str, queries: list[str]) -> None:
    spark.createDataFrame([(q,) for q in queries], "value string").coalesce(1).write.mode("overwrite").text(path)
