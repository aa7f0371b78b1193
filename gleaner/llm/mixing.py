"""Mixing sources to target weights (DataFrame functions only).

The words of each source, document after document in a hash order, form a stream that is packed
into blocks of ``block_words``. A source's target number of words is met by whole passes over its
blocks (epochs) and a part of one more. Every block taken fills one slot of the mix. First the counts of blocks by
output shard and source are drawn: multinomial over the shards given each source's total, because a free
draw would miss a small source's target by the square root of its count. The slots of a shard are the next ones
of each source, as many as drawn. Slot numbers pass through a pseudorandom permutation of the
source's block numbers (a Feistel network over a grid, other keys for each source and epoch), and slots meet
blocks in one join on (source, block): its keys are even whatever the size of a source.

Defined results: a null text has size 0; null is a source of its own, ranked last; documents of
size 0 and of sources without words take 0 words; repeated rows are rows of their own; an empty
table gives an empty result; a rerun gives the same mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.llm._common import WORD, let, parts_for, running_total, stage, text_of

ROUNDS = 4
#: A walk meets each of the fewer than sqrt(n) values out of range once at most, so up to n = 4096 it always ends
#: in time; beyond, each step is out of range with odds below 1 / 64, and a walk that doesn't end fails the job.
WALK = 64
CHUNK = 1 << 15
MOST_TASKS = 20_000


def water_fill(sizes: DataFrame, weights: Sequence[float], most_repeats: float) -> DataFrame:
    """``sizes`` (source, source_size) with rank, weight and target.

    Sources by code point, null last, take ``weights`` in turn and share the sum of all sizes;
    targets stop at ``most_repeats`` times the size, the excess goes to the others by weight. One
    row a source: ordered by cap / weight, the first source whose cap isn't reached sets the level.
    """
    everything = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1)
    by_need = Window.orderBy("_need", "rank")
    out = sizes.withColumn("rank", rank).withColumn("weight", weight)
    out = out.withColumn("_cap", F.lit(float(most_repeats)) * F.col("source_size")).withColumn("_need", F.col("_cap") / F.col("weight"))
    out = out.withColumn("_total", F.sum("source_size").over(everything).cast("double"))
    capped = F.coalesce(F.sum("_cap").over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(by_need.rowsBetween(0, Window.unboundedFollowing))
    out = out.withColumn("_level", (F.col("_total") - capped) / open_weight)
    first_open = F.min(F.when(F.col("_level") <= F.col("_need"), F.struct("_need", "rank", "_level"))).over(everything)
    level = F.coalesce(first_open["_level"], F.max("_need").over(everything))
    out = out.withColumn("target", F.least(F.col("_cap"), level * F.col("weight")))
    return out.select("source", "source_size", "rank", "weight", "target")


def permuted(index: Column, n: Column, key: Column) -> Column:
    """A pseudorandom permutation of 0 .. n-1 for each ``key``: a Feistel network on a grid of
    ceil(sqrt n) by ceil(n / that) points; points beyond n walk on until they are inside."""
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n / a).cast("long")

    def once(x: Column) -> Column:
        def half(s: Column, r: Column) -> Column:
            wide = F.when(r % 2 == 0, a).otherwise(b)
            return F.struct(s["v"].alias("u"), F.pmod(s["u"] + F.pmod(F.xxhash64(key, r, s["v"]), wide), wide).alias("v"))

        start = F.struct((x % a).alias("u"), F.floor(x / a).cast("long").alias("v"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, half, lambda s: s["v"] * a + s["u"])

    def walk(x: Column, _: Column) -> Column:
        return F.when(x < n, x).otherwise(once(x))

    ended = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once(index), walk)
    return let(ended, lambda x: F.when(x < n, x).otherwise(F.raise_error(F.lit("a permutation left its range: use another seed")).cast("long")))


def sized_rows(docs: DataFrame) -> DataFrame:
    """Staged: row (a number), doc_id, source, size in words, and a tie-break for repeated ids."""
    text = text_of(docs)
    return stage(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            docs["source"].cast("string").alias("source"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
            F.xxhash64(text).alias("tie"),
        ),
        "sizes",
    )


def drawn_counts(want: DataFrame, shards: int, slots: float, seed: int) -> DataFrame:
    """The draw: (rank, shard, blocks, first) - how many of a source's slots go to each shard, and the first of them.
    Each of the source's ``slots`` draws a shard by a hash."""
    chunks = want.where("slots > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / F.lit(CHUNK)))))
    chunks = chunks.repartition(min(MOST_TASKS, parts_for(slots, CHUNK)), "rank", "chunk")
    first = F.col("chunk") * F.lit(CHUNK)
    drawn = chunks.select("rank", F.explode(F.sequence(first, F.least(F.col("slots"), first + F.lit(CHUNK)) - 1)).alias("i"))
    drawn = drawn.groupBy("rank", F.pmod(F.xxhash64(F.lit(seed), F.lit("shard"), "rank", "i"), F.lit(shards)).alias("shard")).agg(F.count("*").alias("blocks"))
    before = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return drawn.withColumn("first", F.coalesce(F.sum("blocks").over(before), F.lit(0)))


def mix_slots(rows: DataFrame, targets: DataFrame, *, block_words: int, shard_words: int, seed: int) -> DataFrame:
    """The mix: one row for each piece of a document in a slot: shard, slot, rank, epoch, row,
    word_from (in the document) and words. ``rows`` is from ``sized_rows``, ``targets`` from
    ``water_fill`` and staged."""
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    shards = parts_for(total, shard_words)
    keyed = rows.join(targets.select(F.col("source").alias("_source"), "rank", "source_size"), rows["source"].eqNullSafe(F.col("_source"))).where("size > 0")
    placed = running_total(keyed.select("row", "doc_id", "rank", "size", "tie", "source_size"), ["rank"], ["doc_id", "size", "tie", "row"], F.col("size"), "doc_id", parts_for(n, 50_000), "at")
    span = F.lit(block_words)
    full = F.floor(F.col("source_size") / span)
    blocks = F.sequence(F.floor(F.col("at") / span), F.floor((F.col("at") + F.col("size") - 1) / span))
    pieces = placed.select("row", "rank", "at", "size", F.explode(blocks).alias("block"))
    pieces = pieces.select(
        "row",
        "rank",
        "block",
        F.greatest(F.col("at"), F.col("block") * span).alias("_from"),
        F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * span).alias("_to"),
        "at",
    ).select("row", "rank", "block", (F.col("_from") - F.col("at")).alias("word_from"), (F.col("_from") - F.col("block") * span).alias("lead"), (F.col("_to") - F.col("_from")).alias("words"))

    per_epoch = F.ceil(F.col("source_size") / span)
    want = targets.where("source_size > 0").select("rank", "source_size", F.round("target").cast("long").alias("want"))
    want = want.select(
        "rank",
        full.alias("full"),
        per_epoch.alias("per_epoch"),
        F.floor(F.col("want") / F.col("source_size")).alias("epochs"),
        (F.col("want") % F.col("source_size")).alias("rest"),
    ).withColumn("slots", F.col("epochs") * F.col("per_epoch") + F.ceil(F.col("rest") / span))
    draws = stage(drawn_counts(want, shards, total / block_words, seed), "draws")
    slots = draws.repartition(min(MOST_TASKS, parts_for(total / block_words, CHUNK)), "rank", "shard")
    slots = slots.join(want, "rank").withColumn("slot", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("blocks") - 1)))
    slots = slots.withColumn("epoch", F.floor(F.col("slot") / F.col("per_epoch"))).withColumn("at", F.col("slot") % F.col("per_epoch"))
    key = F.xxhash64(F.lit(seed), F.col("rank"), F.col("epoch"))
    block = F.when(F.col("at") < F.col("full"), permuted(F.col("at"), F.col("full"), key)).otherwise(F.col("at"))
    take = F.when(F.col("epoch") < F.col("epochs"), span.cast("long")).otherwise(F.least(span, F.col("rest") - F.col("at") * span))
    slots = slots.select("rank", "slot", "epoch", block.alias("block"), take.alias("take"), "shard")

    # Spark takes the slots for a few rows, as their sources are; neither side is small.
    met = slots.hint("merge").join(pieces, ["rank", "block"]).withColumn("words", F.least(F.col("words"), F.col("take") - F.col("lead"))).where("words > 0")
    return met.select("shard", "slot", "rank", "epoch", "row", "word_from", "words")


def mix(
    docs: DataFrame, *, weights: Sequence[float] = (1, 2, 3), most_repeats: float = 3.0, block_words: int = 256, shard_words: int = 1 << 22, seed: int = 7
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, targets, slots): sized rows, the targets of their sources, and the mix."""
    rows = sized_rows(docs)
    targets = stage(water_fill(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most_repeats), "targets")
    return rows, targets, mix_slots(rows, targets, block_words=block_words, shard_words=shard_words, seed=seed)


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, and the number of output shards that
    take words of it (shards)."""
    rows, targets, slots = mix(docs, **options)
    taken = slots.groupBy("row", "shard").agg(F.sum("words").alias("_taken")).groupBy("row").agg(F.sum("_taken").alias("_taken"), F.count("*").alias("_shards"))
    out = rows.join(targets.withColumnRenamed("source", "_source"), rows["source"].eqNullSafe(F.col("_source"))).join(taken, "row", "left")
    return out.select("doc_id", "size", F.col("source_size"), "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("_shards", F.lit(0)).cast("int").alias("shards"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: a row for each epoch that takes words of a document.

    A document wholly taken keeps its text unchanged; of one partly taken, the words taken remain,
    in order and joined by one space. Columns are those of ``docs``, n_chars following the text.
    """
    size = F.regexp_count(text_of(docs), F.lit(WORD)).cast("long")
    # A row travels as one column, so that its own columns may have any name.
    whole = stage(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row"), size.alias("size")), "rows")
    text = F.coalesce(F.col("doc.text").cast("string"), F.lit(""))
    rows = whole.select("row", F.col("doc.doc_id").alias("doc_id"), F.col("doc.source").cast("string").alias("source"), "size", F.xxhash64(text).alias("tie"))
    weights, repeats = options.pop("weights", (1, 2, 3)), options.pop("most_repeats", 3.0)
    targets = stage(water_fill(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats), "targets")
    slots = mix_slots(rows, targets, **({"block_words": 256, "shard_words": 1 << 22, "seed": 7} | options))
    taken = slots.groupBy("row", "epoch").agg(F.sum("words").alias("taken"), F.array_sort(F.collect_list(F.struct("word_from", "words"))).alias("spans"))
    taken = taken.groupBy("row").agg(F.collect_list(F.struct("taken", "spans")).alias("epochs"))
    out = whole.join(taken, "row").withColumn("epoch", F.explode("epochs"))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = F.array_join(F.flatten(F.transform("epoch.spans", lambda s: F.slice(words, (s["word_from"] + 1).cast("int"), s["words"].cast("int")))), " ")
    out = out.withColumn("text", F.when(F.col("epoch.taken") >= F.col("size"), F.col("doc.text")).otherwise(cut))
    made = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[made.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])
