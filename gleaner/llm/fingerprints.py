"""Document fingerprints by one-permutation MinHash (DataFrame functions only).

Every shingle of five words is hashed once. The low bits of the hash choose one of ``BINS`` bins, the
others compete for the bin's minimum. An empty bin copies the first full one of a probing order of its
own over all bins (optimal densification). The low ``BITS`` bits of each bin are packed into 64-bit words and
written as hexadecimal. Likeness is the share m of equal bins, corrected for chance agreement of b-bit
values: (m - 2^-b) / (1 - 2^-b), at least 0.

Defined results: words are case-sensitive runs without ASCII blanks; a text of fewer than five words is
one shingle; null and wordless texts have the empty fingerprint, with likeness 1 to each other and
0 to any other; rows are ordered by (doc_id, text hash), nulls first, and the last is followed by the
first; the only row of a table is followed by itself; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.llm._common import BLANKS, let, parts_for, stage, text_of

SHINGLE = 5
BINS = 256
BITS = 8
VALUE_BITS = 48
PER_WORD = 64 // BITS
MOST_RANGES = 1 << 16
PROBES = 16


def _shingle_hashes(text: Column, shingle: int) -> Column:
    words = F.split(F.btrim(text, F.lit(BLANKS)), r"[\x20\x09-\x0D]+")
    ids = F.transform(words, lambda w: F.xxhash64(w))

    def over(ids: Column) -> Column:
        last = F.greatest(F.size(ids) - F.lit(shingle) + 1, F.lit(1))
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(ids, i, shingle)))

    return let(ids, over)


def _binned(hashes: Column) -> Column:
    """BINS entries in order of bin, each the bin's smallest value or the mark of an empty bin."""
    mark = 1 << VALUE_BITS
    step = mark << 1

    def key(h: Column) -> Column:
        value = F.shiftrightunsigned(h, 64 - VALUE_BITS)
        return F.pmod(h, F.lit(BINS)) * F.lit(step) + value

    empty = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: i.cast("long") * F.lit(step) + F.lit(mark))
    ordered = F.sort_array(F.concat(F.transform(hashes, key), empty))

    def firsts(a: Column) -> Column:
        before = lambda i: F.get(a, i - 1)
        return F.filter(a, lambda x, i: (i == 0) | (F.shiftright(x, VALUE_BITS + 1) != F.shiftright(before(i), VALUE_BITS + 1)))

    return F.transform(let(ordered, firsts), lambda x: x % F.lit(step))


def _densified(bins: Column) -> Column:
    """Low BITS bits per bin. An empty bin copies the first full bin of its own probing order: PROBES
    hashed places, then all bins in the order of a pairwise hash."""
    mark, low = 1 << VALUE_BITS, (1 << BITS) - 1

    def any_empty(a: Column) -> Column:
        return F.exists(a, lambda x: x >= mark)

    def fill(bins: Column) -> Column:
        def probe(now: Column, r: Column) -> Column:
            def place(i: Column) -> Column:
                return F.pmod(F.xxhash64(r, i), F.lit(BINS)).cast("int")

            probed = F.transform(now, lambda x, i: F.when(x < mark, x).otherwise(F.get(bins, place(i))))
            return F.when(any_empty(now), probed).otherwise(now)

        def scan(now: Column) -> Column:
            full = F.filter(F.transform(bins, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: s["x"] < mark)

            def least(full: Column, i: Column) -> Column:
                return F.array_min(F.transform(full, lambda s: F.struct(F.xxhash64(i, s["i"]).alias("h"), s["x"].alias("x"))))["x"]

            return let(full, lambda f: F.transform(now, lambda x, i: F.when(x < mark, x).otherwise(least(f, i))))

        probed = F.aggregate(F.sequence(F.lit(1), F.lit(PROBES)), bins, probe)
        return let(probed, lambda p: F.when(any_empty(p), scan(p)).otherwise(p))

    return F.transform(let(bins, fill), lambda x: x.bitwiseAND(F.lit(low).cast("long")))


def packed(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as BINS * BITS / 64 longs; an empty array for a text without words."""

    def pack(low: Column) -> Column:
        def word(k: Column) -> Column:
            out = F.lit(0).cast("long")
            for j in range(PER_WORD):
                out = out.bitwiseOR(F.shiftleft(F.get(low, k * PER_WORD + j), j * BITS))
            return out

        return F.transform(F.sequence(F.lit(0), F.lit(BINS // PER_WORD - 1)), word)

    wordless = F.btrim(text, F.lit(BLANKS)) == ""
    return F.when(wordless, F.array().cast("array<bigint>")).otherwise(let(_densified(_binned(_shingle_hashes(text, shingle))), pack))


def as_text(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: F.lpad(F.lower(F.hex(w)), 64 // 4, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two packed fingerprints."""

    def equal_bins(x: Column, y: Column) -> Column:
        # A byte of d is zero where two bins agree: fold each byte onto its lowest bit and count.
        d = x.bitwiseXOR(y)

        def fold(d: Column, shift: int, keep: int) -> Column:
            return d.bitwiseOR(F.shiftrightunsigned(d, shift)).bitwiseAND(F.lit(keep))

        d = let(d, lambda v: fold(v, 4, 0x0F0F0F0F0F0F0F0F))
        d = let(d, lambda v: fold(v, 2, 0x0303030303030303))
        d = let(d, lambda v: fold(v, 1, 0x0101010101010101))
        return PER_WORD - F.bit_count(d)

    same = F.aggregate(F.zip_with(a, b, equal_bins), F.lit(0), lambda s, x: s + x)
    chance = 2.0**-BITS
    corrected = F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - chance) / (1 - chance))
    both, none = (F.size(a) > 0) & (F.size(b) > 0), (F.size(a) == 0) & (F.size(b) == 0)
    return F.when(both, corrected).when(none, 1.0).otherwise(0.0)


def _range_bucket(value: Column, bounds: list) -> Column:
    """How many of the sorted ``bounds`` are at most ``value``: a search in two levels."""
    wide = max(1, int(len(bounds) ** 0.5))
    heads = bounds[::wide]
    kind = "bigint"

    def at_most(part: Column) -> Column:
        return F.size(F.filter(part, lambda b: b <= value))

    every, tops = F.array(*[F.lit(b).cast(kind) for b in bounds]), F.array(*[F.lit(b).cast(kind) for b in heads])
    block = F.greatest(at_most(tops) - 1, F.lit(0))
    return let(block, lambda k: k * wide + at_most(F.slice(every, k * wide + 1, wide)))


def with_next(rows: DataFrame, columns: list[str], add, bucket_rows: int) -> DataFrame:
    """``add(rows)`` with next_<c> for each of its ``columns``: those of the next row by
    (doc_id, _tie), cyclically.

    Rows go to ranges of doc_id of about ``bucket_rows`` each, MOST_RANGES at most; in a range the
    next row is a lead(), and the last row of a range takes the first of the next range that has
    any. Those first rows, one a range, are the only ones looked up by broadcast.
    """
    n = rows.count()
    cuts = min(MOST_RANGES, parts_for(n, bucket_rows))
    fractions = [i / cuts for i in range(1, cuts)] or [1.0]
    found = rows.agg(F.percentile_approx("doc_id", F.array(*[F.lit(f) for f in fractions]), F.lit(min(100 * cuts, 1 << 20)))).first()[0]
    bounds = sorted({int(b) for b in found or [0]})
    rows = rows.withColumn("_bucket", F.when(F.col("doc_id").isNull(), 0).otherwise(_range_bucket(F.col("doc_id"), bounds)).cast("int"))
    firsts = stage(rows.groupBy("_bucket").agg(F.min(F.struct("doc_id", "_tie")).alias("_first")), "firsts")
    ring = Window.orderBy("_bucket")
    before = F.coalesce(F.lag("_bucket").over(ring), F.max("_bucket").over(Window.partitionBy()))
    firsts = firsts.select(F.col("_bucket").alias("_b"), F.col("_first.doc_id").alias("_id"), F.col("_first._tie").alias("_t"), before.alias("_before"))
    at = (rows["_bucket"] == F.col("_b")) & rows["doc_id"].eqNullSafe(F.col("_id")) & (rows["_tie"] == F.col("_t"))
    held = F.struct(*columns)
    heads = add(rows.join(F.broadcast(firsts), at)).select(F.col("_before").alias("_bucket"), held.alias("_next")).dropDuplicates(["_bucket"])
    within = Window.partitionBy("_bucket").orderBy(F.col("doc_id").asc_nulls_first(), "_tie")
    out = add(rows).withColumn("_next", F.lead(held).over(within)).join(heads.withColumnRenamed("_next", "_wrapped"), "_bucket", "left")
    following = F.coalesce("_next", "_wrapped")
    return out.select("*", *[following[c].alias(f"next_{c}") for c in columns]).drop("_next", "_wrapped", "_bucket")


def fingerprints(docs: DataFrame, *, shingle: int = SHINGLE, bucket_rows: int = 5_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. The edited text is the text with its last quarter replaced by the
    beginning of the next document."""
    text = text_of(docs)
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("_tie"))
    rows = with_next(rows, ["text", "print"], lambda r: r.withColumn("print", packed(F.col("text"), shingle)), bucket_rows)
    n = F.length("text").cast("long")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - quarter), F.substring(F.col("next_text"), F.lit(1), quarter))
    rows = rows.select("doc_id", n.alias("n_chars"), edited.alias("edited"), "print", "next_print")
    rows = rows.withColumn("edited_print", packed(F.col("edited"), shingle))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("print")).alias("fingerprint"),
        as_text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
