"""Exact deduplication by two passes over a Bloom filter (DataFrame functions only).

Pass 1 finds, for a Bloom filter whose cells lie in at most REGIONS regions, the cells that more than one row
hits: each task sends the places hit in a region as one array. Pass 2 tests every row: a row with a
cell that no other row hits is certainly unique and passes straight through; only the others shuffle
and are grouped by their full SHA-256. The filter has no false negatives, so results are exact.

A filter has at most ``max_filter_bits``, so that it can be broadcast, and 16 bits a row. Where rows need more,
they are written in ranges of their digest, without a shuffle, and each range has a filter of its own, one after
the other: the filter's density is the same at any size.

Defined results: a null text counts as empty; equal doc_ids with equal texts are ordered by an
internal row number, so exactly one row of a group is kept; a null doc_id is smaller than any
other; other columns are untouched; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm._common import parts_for, stage, stage_path, text_of

#: Groups above this share of all rows are joined by broadcast: at most 4096 of them can exist.
HOT_SHARE = 4096
HASHES = 2
ROW_BITS = 16
REGIONS = 2048


def _filter_bits(rows: int) -> int:
    bits = 1 << 10
    while bits < ROW_BITS * rows:
        bits <<= 1
    return bits


def _ranges(rows: int, max_filter_bits: int) -> tuple[int, int]:
    """How many ranges of digests there are, and the bits of each one's filter."""
    ranges = parts_for(ROW_BITS * rows, max_filter_bits)
    return ranges, min(_filter_bits(parts_for(rows, ranges)), max_filter_bits)


def _range_of(digest: Column, ranges: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("range"), digest), F.lit(ranges)).cast("int")


def _cells(digest: str, bits: int) -> list:
    """One cell in each of HASHES equal parts of the filter."""
    part = bits // HASHES
    return [F.pmod(F.xxhash64(F.lit(i), F.col(digest)), F.lit(part)) + F.lit(i * part) for i in range(HASHES)]


def repeat_filter(rows: DataFrame, digest: str, bits: int) -> DataFrame:
    """Words of 64 bits: a bit is set where two or more rows hit the cell. At most bits / 64 rows."""
    wide = max(64, bits // REGIONS)
    cells = rows.select(F.explode(F.array(*_cells(digest, bits))).alias("cell"))
    # A task sends at most REGIONS rows, whatever the number of its rows.
    regions = cells.groupBy(F.expr(f"cell div {wide}").alias("region")).agg(F.sort_array(F.collect_list(F.expr(f"cast(cell % {wide} as int)"))).alias("places"))
    again = regions.select("region", F.explode(F.filter("places", lambda x, i: (i > 0) & (x == F.get("places", i - 1)))).alias("place"))
    cell = F.col("region") * wide + F.col("place")
    return again.groupBy(F.floor(cell / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("bits"))


def mark_suspects(rows: DataFrame, digest: str, words: DataFrame, bits: int) -> DataFrame:
    """Adds ``_suspect``: false for rows that are certainly the only ones with their digest."""
    suspect = F.lit(True)
    for i, cell in enumerate(_cells(digest, bits)):
        rows = rows.withColumn(f"_cell{i}", cell).withColumn(f"_word{i}", F.expr(f"_cell{i} div 64"))
        side = F.broadcast(words.select(F.col("word").alias(f"_word{i}"), F.col("bits").alias(f"_bits{i}")))
        rows = rows.join(side, f"_word{i}", "left")
        suspect = suspect & F.expr(f"coalesce(getbit(_bits{i}, cast(_cell{i} % 64 as int)), 0) = 1")
    rows = rows.withColumn("_suspect", suspect)
    return rows.drop(*[f"_{what}{i}" for i in range(HASHES) for what in ("cell", "word", "bits")])


def _marked(rows: DataFrame, ranges: int, bits: int) -> DataFrame:
    """``rows`` (with digest and, in several ranges, _range) with ``_suspect``, staged. Each range meets its own filter."""
    path = stage_path(rows.sparkSession, "marked")
    for r in range(ranges):
        part = rows.where(F.col("_range") == r) if ranges > 1 else rows
        words = stage(repeat_filter(part, "digest", bits), "filter")
        mark_suspects(part, "digest", words, bits).write.mode("append").partitionBy("_suspect").parquet(path)
    fields = rows.schema.add("_suspect", "boolean")
    return rows.sparkSession.read.schema(fields).parquet(path)


def exact_duplicates(docs: DataFrame, *, max_filter_bits: int = 1 << 27) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    n = docs.count()
    ranges, bits = _ranges(n, max_filter_bits)
    digest = F.unhex(F.sha2(text_of(docs).cast("binary"), 256))
    rows = docs.select("doc_id", digest.alias("digest"), F.monotonically_increasing_id().alias("row"), *[_range_of(digest, ranges).alias("_range")] * (ranges > 1))
    marked = _marked(stage(rows, "digests", by=["_range"] * (ranges > 1)), ranges, bits)
    suspects = marked.where("_suspect").select("doc_id", "digest", "row")
    groups = stage(
        suspects.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("group_size")).where("group_size > 1"),
        "groups",
    )
    hot = F.broadcast(groups.where(F.col("group_size") > n / HOT_SHARE))
    cold = groups.where(F.col("group_size") <= n / HOT_SHARE)
    of_hot = suspects.join(hot, "digest")
    rest = suspects.join(F.broadcast(groups.where(F.col("group_size") > n / HOT_SHARE).select("digest")), "digest", "left_anti")
    of_cold = rest.join(cold, "digest", "left")
    alone = marked.where(~F.col("_suspect")).select("digest", "doc_id", "row", F.lit(None).cast(groups.schema["keep"].dataType).alias("keep"), F.lit(None).cast("long").alias("group_size"))
    out = of_hot.unionByName(of_cold).unionByName(alone)
    return out.select(
        "doc_id",
        F.when(F.col("keep").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep.row") == F.col("row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, *, max_filter_bits: int = 1 << 27) -> DataFrame:
    """``docs`` with one row of each group of equal texts, the one with the largest doc_id.

    Whole rows of certainly unique texts stay in their partition; only suspects shuffle. In several ranges,
    whole rows are written by range first and each range is read once more.
    """
    ranges, bits = _ranges(docs.count(), max_filter_bits)
    digest = F.unhex(F.sha2(text_of(docs).cast("binary"), 256))
    # A row travels as one column, so that its own columns may have any name.
    whole = docs.select(F.struct(*docs.columns).alias("doc"), digest.alias("digest"), *[_range_of(digest, ranges).alias("_range")] * (ranges > 1))
    if ranges > 1:
        whole = stage(whole, "whole", by=["_range"])

    def survivors(part: DataFrame) -> DataFrame:
        small = stage(part.select(F.col("doc.doc_id").alias("doc_id"), "digest"), "digests", reclaim=True)
        words = stage(repeat_filter(small, "digest", bits), "filter")
        keepers = mark_suspects(small, "digest", words, bits).where("_suspect").groupBy("digest").agg(F.max("doc_id").alias("keep"))
        marked = mark_suspects(part, "digest", words, bits)
        alone = marked.where(~F.col("_suspect")).select("doc.*")
        rest = marked.where("_suspect")
        kept = (rest["digest"] == keepers["digest"]) & rest["doc.doc_id"].eqNullSafe(keepers["keep"])
        return alone.unionByName(rest.join(keepers, kept, "left_semi").dropDuplicates(["digest"]).select("doc.*"))

    if ranges == 1:
        return survivors(whole)
    path = stage_path(docs.sparkSession, "survivors")
    for r in range(ranges):
        survivors(whole.where(F.col("_range") == r)).write.mode("append").parquet(path)
    return docs.sparkSession.read.schema(docs.schema).parquet(path)
