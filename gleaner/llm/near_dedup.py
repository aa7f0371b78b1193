"""Near-duplicate detection: b-bit MinHash signatures, multi-index Hamming join, exact confirmation.

Documents with equal shingle sets are one class. Each class has a signature of CHUNKS * SPAN values of
16 bits. Two signatures that differ in at most CHUNKS * (ERRORS + 1) - 1 values have, by the pigeonhole
principle, a chunk of SPAN values with at most ERRORS of them different; every choice of ERRORS values
left out of every chunk is a key, so all pairs under that distance share a key. A pair at similarity 0.8
differs in a fifth of the values; at the defaults the guarantee reaches two fifths, and the odds that no
key is shared are (0.263)^12 = 1e-7.

No group emits all its pairs. Round 1 compares each member of a key with the key's smallest member only,
and makes components of the confirmed links. Later pairs matter only between different components: round 2
compares, within each key of at most MOST_MEMBERS members, those of different components. Classes of wider keys -
a template that thousands of otherwise different documents share - meet on the prefixes of their full
sets instead: in any one order of all shingles, two sets of sizes x and y with overlap t / (1 + t) * (x + y) have
a common shingle among the first x - overlap + 1 of one and y - overlap + 1 of the other. The order is by
frequency, rarest first, so shared templates come last; prefixes are cut for each range of partner sizes.
That is exact for every pair. The components of all rounds' links are those of all links.
Candidates of narrow keys must agree in size and in half of the signature; all links are confirmed on full sets.

Defined results: null and wordless texts have the empty set, link with nothing and are all kept;
rows that repeat a doc_id are one node with the links of all its texts; a null doc_id is no node: its row comes back
with null component and is kept; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import _words
from gleaner.llm._common import drop_staged, parts_for, stage
from gleaner.llm.components import components

CHUNKS, SPAN, ERRORS = 12, 5, 1
VALUES = CHUNKS * SPAN
#: Keys of more members are compared by prefixes of the full sets.
MOST_MEMBERS = 64
#: Frequencies of shingles are counted by hash in so many cells; any counts give an exact join.
CELLS = 1 << 18
#: Partner sizes of a prefix differ by this factor at most.
SIZE_STEP = 1.05
_multipliers = np.random.default_rng(11).integers(1, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): document i has the distinct, sorted shingle hashes first[i] .. first[i+1]-1."""
    raw, starts, ends, first = _words.split(texts, lower=True)
    words = _words.hashes(raw, starts, ends)
    counts = np.diff(first)
    doc = np.repeat(np.arange(len(counts)), counts)
    runs = _words.grams(words, shingle)
    inside = doc[: len(runs)] == doc[shingle - 1 :] if len(runs) else np.empty(0, bool)
    values, owner = runs[inside], doc[: len(runs)][inside]
    for i in np.flatnonzero((counts > 0) & (counts < shingle)):
        short = words[first[i] : first[i + 1]]
        values = np.append(values, _words.grams(np.r_[np.uint64(len(short)), short], len(short) + 1))
        owner = np.append(owner, i)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(len(counts) + 1))


def _signatures(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of VALUES 16-bit numbers for each document with a set; zeros for others."""
    out = np.zeros((len(first) - 1, VALUES), np.uint16)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        for k, m in enumerate(_multipliers):
            h = (values * m) >> np.uint64(20)
            least = np.minimum.reduceat(h, first[:-1][full])
            out[full, k] = _words.mixed(least).astype(np.uint16)
    return out


def _digests(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Two 64-bit digests of each set."""
    digest = np.zeros((2, len(first) - 1), np.uint64)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        digest[0, full] = np.add.reduceat(_words.mixed(values), first[:-1][full])
        digest[1, full] = np.bitwise_xor.reduceat(_words.mixed(values ^ np.uint64(0x5DEECE66D)), first[:-1][full])
    return digest.view(np.int64)


def _sketch(shingle: int):
    def run(batches):
        for batch in batches:
            for a, b in _words.slices(batch["text"]):
                values, first = shingle_sets(batch["text"].slice(a, b - a), shingle)
                n = np.diff(first)
                digest = _digests(values, first)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch["doc_id"].slice(a, b - a),
                        "n_shingles": pa.array(n, pa.int64()),
                        "d1": pa.array(digest[0]),
                        "d2": pa.array(digest[1]),
                        "signature": pa.array([x.tobytes() for x in _signatures(values, first)], pa.binary()),
                    }
                )

    return run


def _keys(batches):
    """Each signature's keys: for each chunk and each choice of values left out, a hash of the rest."""
    kept = [(c, [c * SPAN + i for i in range(SPAN) if i not in out]) for c in range(CHUNKS) for out in combinations(range(SPAN), ERRORS)]
    for batch in batches:
        for a in range(0, len(batch), 4096):
            part = batch.slice(a, 4096)
            values = np.frombuffer(b"".join(part["signature"].to_pylist()), np.uint16).reshape(-1, VALUES).astype(np.uint64)
            keys = np.empty((len(kept), len(part)), np.uint64)
            for k, (_, columns) in enumerate(kept):
                h = np.full(len(part), k, np.uint64)
                for c in columns:
                    h = _words.mixed(h + np.uint64(_words.BASE)) + values[:, c]
                keys[k] = _words.mixed(h)
            yield pa.RecordBatch.from_arrays([pa.array(keys.T.ravel().view(np.int64)), part["id"].take(pa.array(np.repeat(np.arange(len(part)), len(kept))))], ["key", "id"])


def _agree(shingle_cut: int):
    """Filters candidate pairs by size and signature: (a, b, sizes and signatures of both)."""

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            sa, sb = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint16).reshape(-1, VALUES) for c in ("sa", "sb"))
            na, nb = (batch[c].to_numpy(zero_copy_only=False) for c in ("na", "nb"))
            fits = 100 * np.minimum(na, nb) >= shingle_cut * np.maximum(na, nb)
            keep = fits & ((sa == sb).sum(1) >= VALUES // 2)
            yield pa.RecordBatch.from_arrays([batch[c].filter(pa.array(keep)) for c in ("a", "b", "na", "nb")], ["a", "b", "na", "nb"])

    return run


def _of_class(batch, shingle: int):
    """(row, set) of the rows of ``batch`` (doc text, d1 and d2 of a class) whose text is of that class:
    where a doc_id repeats, a class meets the texts of all its rows."""
    for a, b in _words.slices(batch["text"]):
        values, first = shingle_sets(batch["text"].slice(a, b - a), shingle)
        digest = _digests(values, first)
        wanted = np.stack([batch[c].slice(a, b - a).to_numpy(zero_copy_only=False) for c in ("d1", "d2")])
        for i in np.flatnonzero((digest == wanted).all(0)).tolist():
            yield a + i, values[first[i] : first[i + 1]]


def _confirm(shingle: int, percent: int):
    """Confirms pairs within one block: (block, id, node, d1, d2, text, partners)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        batch = {c: table[c].chunk(0) if table.num_rows else table[c] for c in table.column_names}
        ids, nodes, partners = (table[c].to_pylist() for c in ("id", "node", "partners"))
        sets: dict[int, np.ndarray] = {}
        node, wanted = dict(zip(ids, nodes, strict=True)), dict(zip(ids, partners, strict=True))
        for i, found in _of_class(batch, shingle):
            sets.setdefault(ids[i], found)
        out: list[tuple[int, int]] = []
        for x, mine in sets.items():
            for y in wanted[x] or ():
                other = sets[y]
                both = len(np.intersect1d(mine, other, assume_unique=True))
                if 100 * both >= percent * (len(mine) + len(other) - both):
                    out.append((node[x], node[y]))
        sets.clear()
        _words.tidy()
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def _confirmed(pairs: DataFrame, classes: DataFrame, texts: DataFrame, shingle: int, percent: int, block_shingles: int) -> DataFrame:
    """The links among ``pairs`` (a, b: class ids; na, nb: sizes), as pairs of nodes. Pairs go to blocks by b, split by a where
    b has many; a block holds each text that its pairs need once, and its pairs have about ``block_shingles`` together."""
    pairs = stage(pairs.distinct(), "pairs", compact=True)
    cost = F.col("na") + F.col("nb")
    blocks = parts_for(pairs.agg(F.coalesce(F.sum(cost), F.lit(0))).first()[0], block_shingles)
    spread = pairs.groupBy("b").agg(F.sum(cost).alias("m")).where(F.col("m") > block_shingles).select("b", F.ceil(F.col("m") / block_shingles).alias("salts"))
    placed = pairs.join(spread, "b", "left")
    salt = F.pmod(F.xxhash64("a"), F.coalesce("salts", F.lit(1)))
    placed = placed.select("a", "b", F.pmod(F.xxhash64("b", salt), F.lit(blocks)).alias("block"))
    wanted = placed.groupBy("block", "a").agg(F.collect_list("b").alias("partners")).withColumnRenamed("a", "id")
    also = placed.select("block", F.col("b").alias("id")).distinct()
    need = wanted.join(also, ["block", "id"], "full").join(classes.select("id", "node", "d1", "d2"), "id")
    with_text = need.join(texts, need["node"] == texts["doc_id"]).drop("doc_id")
    return stage(with_text.groupBy("block").applyInArrow(_confirm(shingle, percent), "a long, b long"), "confirmed", reclaim=True, compact=True)


def _cell(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(46)).astype(np.int64)


def _counts(shingle: int):
    """(cell, c): how many sets of the partition have a shingle in each cell."""

    def run(batches):
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for _, found in _of_class(batch, shingle):
                np.add.at(total, _cell(found), 1)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(total[hit])], ["cell", "c"])
        _words.tidy()

    return run


def prefixes(size: int, percent: int) -> list[tuple[int, int, int]]:
    """(lower range, upper range, length) of the prefixes of a set of ``size``: one for each range of partner
    sizes, ranges being powers of SIZE_STEP. The order of the two ranges is the same for both partners."""
    step = np.log(SIZE_STEP)
    mine = int(np.log(size) / step + 1e-9)
    out = []
    for other in range(int(np.log(max(1, size * percent / 100)) / step - 1), int(np.log(size * 100 / percent) / step + 1) + 1):
        # The smallest partner in that range; a size on the edge may fall on either side.
        least = max(int(np.ceil(np.exp(other * step) * (1 - 1e-6))), -(-size * percent // 100), 1)
        overlap = -(-percent * (size + least) // (100 + percent))
        if other >= 0 and overlap <= size:
            out.append((min(mine, other), max(mine, other), size - overlap + 1))
    return out


def _prefixed(shingle: int, percent: int, counts: np.ndarray):
    """(token, low, high, id, component, n, place): the prefixes of each set, rarest shingles first."""

    def run(batches):
        for batch in batches:
            ids, components, nodes = (batch[c].to_numpy(zero_copy_only=False) for c in ("id", "component", "node"))
            for i, found in _of_class(batch, shingle):
                order = found[np.lexsort((found, counts[_cell(found)]))].view(np.int64)
                rows = prefixes(len(order), percent)
                if not rows:
                    continue
                low, high, n = (np.array(c) for c in zip(*rows, strict=True))
                take = np.concatenate([np.arange(k) for k in n])
                total = len(take)
                full = lambda v: pa.array(np.full(total, v, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(order[take]), pa.array(np.repeat(low, n), pa.int32()), pa.array(np.repeat(high, n), pa.int32()), full(ids[i]), full(nodes[i]), full(components[i]), full(len(order)), pa.array(take, pa.int64())],
                    ["token", "low", "high", "id", "node", "component", "n", "place"],
                )

    return run


def _prefix_pairs(hot: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(a, b, na, nb): pairs of ``hot`` classes (id, node, d1, d2, component) of different components whose sets may
    overlap enough: every pair that does is among them."""
    full = hot.join(texts, hot["node"] == texts["doc_id"]).drop("doc_id")
    sums = full.select("d1", "d2", "text").mapInArrow(_counts(shingle), "cell int, c long").groupBy("cell").agg(F.sum("c").alias("c")).toArrow()  # at most CELLS rows
    counts = np.zeros(CELLS, np.int64)
    counts[sums["cell"].to_numpy()] = sums["c"].to_numpy()
    made = "token long, low int, high int, id long, node long, component long, n long, place long"
    tokens = stage(full.mapInArrow(_words.tidied(_prefixed(shingle, percent, counts)), made), "prefixes", reclaim=True)
    at = ["token", "low", "high"]
    company = tokens.groupBy(*at).agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 <> c2").select(*at)
    tokens = tokens.join(company, at)
    left, right = (tokens.select(*at, F.col("id").alias(x), F.col("component").alias(f"c{x}"), F.col("n").alias(f"n{x}"), F.col("place").alias(f"p{x}")) for x in ("a", "b"))
    room = F.lit(100 + percent) * F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= F.lit(percent) * (F.col("na") + F.col("nb"))
    fits = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return left.join(right, at).where((F.col("a") > F.col("b")) & (F.col("ca") != F.col("cb")) & fits & room).select("a", "b", "na", "nb")


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, block_shingles: int = 1 << 20, most_members: int = MOST_MEMBERS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    sketches = stage(texts.mapInArrow(_words.tidied(_sketch(shingle)), "doc_id long, n_shingles long, d1 long, d2 long, signature binary"), "sketches", reclaim=True, compact=True)
    of = ["n_shingles", "d1", "d2"]
    nodes = sketches.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # A class has a number of its own; its node is the smallest doc_id with it.
    classes = nodes.groupBy(*of).agg(F.min("doc_id").alias("node"), F.min("signature").alias("signature"))
    classes = stage(classes.withColumn("id", F.monotonically_increasing_id()), "classes", reclaim=True, compact=True)
    keyed = classes.select("id", "signature").mapInArrow(_words.tidied(_keys), "key long, id long")
    keyed = stage(keyed, "keys", reclaim=True)
    low = keyed.groupBy("key").agg(F.min("id").alias("low"), F.count("*").alias("m")).where("m > 1").drop("m")
    shared = stage(keyed.join(low, "key"), "shared", reclaim=True, compact=True)  # key, id, low: keys with company
    drop_staged(keyed)

    def filtered(pairs: DataFrame) -> DataFrame:
        for x in ("a", "b"):
            pairs = pairs.join(classes.select(F.col("id").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("signature").alias(f"s{x}")), x)
        return pairs.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_words.tidied(_agree(percent)), "a long, b long, na long, nb long")

    # The texts of any row with a class' node; repeated ids are told apart by their digests.
    rep_texts = texts.join(classes.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")

    # A doc_id with several texts ties their classes together.
    repeated = sketches.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct(*of)).alias("x"), F.max(F.struct(*of)).alias("y")).where("x <> y").select("doc_id")
    ties = sketches.drop("signature").join(repeated, "doc_id").join(classes.select(*of, "node"), of).select(F.col("doc_id").alias("a"), F.col("node").alias("b"))

    stars = shared.where("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b")).distinct()
    links = _confirmed(filtered(stars), classes, rep_texts, shingle, percent, block_shingles).unionByName(ties)
    groups = stage(components(links), "groups")
    placed = classes.join(groups.withColumnRenamed("id", "node"), "node", "left").select("id", "node", "d1", "d2", F.coalesce("component", "node").alias("component"))
    labelled = shared.join(placed.select("id", "component"), "id").select("key", "id", "component")
    mixed = labelled.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.count("*").alias("m")).where("c1 <> c2").select("key", "m")
    open_keys = stage(labelled.join(mixed, "key"), "open", reclaim=True, compact=True)
    narrow = open_keys.where(F.col("m") <= most_members)
    left, right = (narrow.select("key", F.col("id").alias(x), F.col("component").alias(f"c{x}")) for x in ("a", "b"))
    cross = left.join(right, "key").where("ca <> cb AND a > b").select("a", "b").distinct()
    cross = cross.join(stars, ["a", "b"], "left_anti")  # those were compared in round 1
    pairs = filtered(cross)
    wide = open_keys.where(F.col("m") > most_members).select("id").distinct()
    hot = stage(placed.join(wide, "id"), "hot", reclaim=True, compact=True)
    if not hot.isEmpty():
        pairs = pairs.unionByName(_prefix_pairs(hot, rep_texts, shingle, percent))
    more = _confirmed(pairs, classes, rep_texts, shingle, percent, block_shingles)
    final = stage(components(groups.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more)), "groups")

    root = classes.join(final.withColumnRenamed("id", "node"), "node", "left").select(*of, F.coalesce("component", "node").alias("component"))
    hit = sketches.drop("signature").join(root, of, "left")
    wordless = hit.where("n_shingles = 0").drop("component").join(final.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component"))
    hit = hit.where("n_shingles > 0").select("doc_id", "n_shingles", "component").unionByName(wordless)
    component = F.when(F.col("doc_id").isNotNull(), F.col("component"))
    return hit.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without those that a near duplicate with a smaller doc_id stands for."""
    marks = near_duplicates(docs, **options)
    gone = marks.where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti").select(*docs.columns)
