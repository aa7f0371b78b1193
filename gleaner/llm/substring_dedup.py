"""Substring deduplication with a log-structured index of window hashes.

A window is ``WINDOW`` consecutive words of one document. Documents are taken in batches of ascending
doc_id. The index is a list of immutable runs; a run holds, for every bucket (a range of window hashes),
the sorted distinct hashes of the windows of one or more batches. A new batch is hashed in the map
tasks, each of which keeps a hash's first window and marks the later ones of its own slice, and of earlier slices
where a hash has repeated before, so a window that a third of all documents share is sent about once a task. Blocks
of hashes meet the runs' blocks of their bucket, where the batch is merge-joined with every run: a
hash found in a run started in an earlier document; among equals of the batch, all but the first by (doc_id,
start) are repeats. Matches are verified by 24 bits of an independent hash, from the window's bytes on,
held beside the 64 bits of the first. New hashes make a new run; where ``max_runs`` runs exist, that task, which
has all their blocks at hand, compacts them and the new hashes to one.

An index lives in its folder: a manifest names its runs and is replaced when a run is complete, so ``open`` finds
the index as of the last whole batch, in this session or a later one. Runs are plain Parquet tables of a
bounded number of files, read by Spark, in any file system that it knows.

Marked windows come back as blocks by document bucket, meet the texts there, and the words that they
cover go. Windows are judged on the input, not on what is left.

Defined results: words are case-sensitive; a null text has none and an empty rest; documents shorter
than the window stay whole; rows that repeat a doc_id with other texts are ordered by their text's hash, and rows
wholly equal count as one; a null doc_id comes before any other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import _words
from gleaner.llm._common import _delete, file_system, free_shuffles, parts_for, stage_path

WINDOW = 20
MAX_RUNS = 4
#: A table is taken in so many batches, with OWN_RUNS runs compacted with the next one on the way.
BATCHES, OWN_RUNS = 5, 2
NO_ID = -(1 << 63)
#: Bytes of text whose marked windows make a document bucket; twice that make a bucket of the index.
BUCKET_BYTES = 4 << 20
#: Bytes of text that a map task deduplicates by itself before it sends hashes.
SLICE_BYTES = 2 << 20
#: Repeated hashes that a map task remembers between slices.
MOST_HOT = 200_000
CHECK_SEED = 77


def _squeezed(columns: list[np.ndarray]) -> bytes:
    """Arrays byte plane by byte plane, compressed: planes of zeros and of few values nearly vanish."""
    raw = b"".join(c.view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns)
    return struct.pack("<I", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def _restored(block: bytes, kinds: list[tuple[type, int]]) -> list[np.ndarray]:
    raw = pa.decompress(block[4:], decompressed_size=struct.unpack_from("<I", block)[0], codec="zstd", asbytes=True)
    at, out = 0, []
    for kind, n in kinds:
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += n * size
    return out


def _pack(doc: np.ndarray, tie: np.ndarray, start: np.ndarray, *more: np.ndarray) -> bytes:
    """Columns of windows, ordered by (doc, tie, start): documents by run length, starts as given."""
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.r_[at, len(doc)])
    columns = [np.diff(doc[at], prepend=np.int64(0)), tie[at].astype(np.int32), count.astype(np.uint32), start.astype(np.uint32), *more]
    return struct.pack("<II", len(at), len(doc)) + _squeezed(columns)


def _unpack(block: bytes, *more: type) -> list[np.ndarray]:
    docs, n = struct.unpack_from("<II", block)
    doc, tie, count, *rest = _restored(block[8:], [(np.int64, docs), (np.int32, docs), (np.uint32, docs), (np.uint32, n), *((m, n) for m in more)])
    return [np.repeat(np.cumsum(doc), count), np.repeat(tie, count), *rest]


def _entry_block(h: np.ndarray, check: np.ndarray) -> bytes:
    """A bucket of a run: sorted hashes as differences, and their checks."""
    return struct.pack("<I", len(h)) + _squeezed([np.diff(h, prepend=np.uint64(0)), check])


def _entries(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = struct.unpack_from("<I", block)[0]
    steps, check = _restored(block[4:], [(np.uint64, n), (np.uint32, n)])
    return np.cumsum(steps), check


def _bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _doc_bucket(doc: np.ndarray, doc_buckets: int) -> np.ndarray:
    return np.mod(doc ^ (doc.view(np.uint64) >> np.uint64(17)).view(np.int64), doc_buckets)


def _doc_bucket_column(doc_id: Column, doc_buckets: int) -> Column:
    """``_doc_bucket`` as a column."""
    doc = F.coalesce(doc_id, F.lit(NO_ID))
    return F.pmod(doc.bitwiseXOR(F.shiftrightunsigned(doc, 17)), F.lit(doc_buckets)).cast("int")


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def _ties(texts: pa.Array) -> np.ndarray:
    """A hash of each text, which orders rows that repeat a doc_id."""
    return np.array([int.from_bytes(hashlib.blake2b(t, digest_size=4).digest(), "little", signed=True) for t in texts.fill_null("").cast(pa.binary()).to_pylist()], np.int32)


def _sorted(h, check, doc, tie, start) -> np.ndarray:
    """The order by (h, check, doc, tie, start). Few hashes repeat, so only those are ordered by all."""
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    many = np.flatnonzero(np.r_[same, False] | np.r_[False, same])
    of = order[many]
    order[many] = of[np.lexsort((start[of], tie[of], doc[of], check[of], h[of]))]
    return order


def _first_and_later(h, check, doc, tie, start) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted windows: which are the first with their hashes, and which start later than that
    one. Rows that are wholly equal share their places, so they are neither."""
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (check[1:] != check[:-1])
    if not len(h):
        return first, first
    lead = np.flatnonzero(first)[np.cumsum(first) - 1]
    return first, (doc != doc[lead]) | (tie != tie[lead]) | (start != start[lead])


def _found(kh: np.ndarray, kc: np.ndarray, h: np.ndarray, check: np.ndarray) -> np.ndarray:
    """The place of each (h, check) among sorted hashes and their checks, -1 where there is none. A hash may
    have several checks."""
    at, end = np.searchsorted(kh, h, "left"), np.searchsorted(kh, h, "right")
    place = np.full(len(h), -1)
    left = np.flatnonzero(at < end)
    while len(left):
        hit = kc[at[left]] == check[left]
        place[left[hit]] = at[left[hit]]
        at[left] += 1
        left = left[~hit & (at[left] < end[left])]
    return place


class _Hot:
    """Hashes that have repeated in a map task, each with the first of its windows so far."""

    def __init__(self) -> None:
        self.columns = [np.empty(0, k) for k in (np.uint64, np.uint32, np.int64, np.int32, np.uint32)]

    def later(self, h, check, doc, tie, start) -> np.ndarray:
        """Which windows start later than a window already sent."""
        kh, kc, kd, kt, ks = self.columns
        place = _found(kh, kc, h, check)
        out = place >= 0
        p = place[out]
        d, t, s = doc[out], tie[out], start[out]
        out[out] = (d > kd[p]) | (d == kd[p]) & ((t > kt[p]) | (t == kt[p]) & (s > ks[p]))
        return out

    def add(self, *windows: np.ndarray) -> None:
        """Takes in windows that were sent."""
        columns = [np.concatenate(c) for c in zip(self.columns, windows, strict=True)]
        order = _sorted(*columns)
        columns = [c[order] for c in columns]
        first = _first_and_later(*columns)[0]
        self.columns = [c[first][:MOST_HOT] for c in columns]


def _hash_windows(window: int, buckets: int, doc_buckets: int):
    """Map side: (bucket, kind, block). Kind 0: hashes to look up. Kind 1: windows already marked,
    with the document bucket in front."""

    def run(batches):
        hot = _Hot()
        for batch in batches:
            ids = _ids(batch["doc_id"])
            for a, b in _words.slices(batch["text"], SLICE_BYTES):
                texts = batch["text"].slice(a, b - a)
                ties, mine = _ties(texts), ids[a:b]
                turn = np.lexsort((ties, mine))
                texts, ties, mine = texts.take(pa.array(turn)), ties[turn], mine[turn]
                # Windows in the order of (doc, tie, start) from here on.
                raw, starts, ends, first = _words.split(texts)
                words, other = _words.hashes(raw, starts, ends), _words.hashes(raw, starts, ends, CHECK_SEED)
                del raw, ends
                counts = np.diff(first)
                owner = np.repeat(np.arange(b - a), counts)
                h = _words.grams(words, window)
                inside = owner[: len(h)] == owner[window - 1 :] if len(h) else np.empty(0, bool)
                at = np.flatnonzero(inside)
                h, check, owner = h[at], (_words.grams(other, window) >> np.uint64(40)).astype(np.uint32)[at], owner[at]
                start = (at - first[owner]).astype(np.uint32)
                doc, tie = mine[owner], ties[owner]
                order = _sorted(h, check, doc, tie, start)
                columns = [c[order] for c in (h, check, doc, tie, start)]
                lead, later = _first_and_later(*columns)
                again = np.zeros(len(h), bool)
                again[order] = later
                again |= hot.later(h, check, doc, tie, start)
                # A hash that repeats here is hot from now on, by its first window if that is sent.
                repeats = lead & np.r_[~lead[1:], False] if len(h) else lead
                new = order[repeats]
                new = new[~again[new]]
                if len(new):
                    hot.add(h[new], check[new], doc[new], tie[new], start[new])
                yield from _blocks(1, buckets, _doc_bucket(doc, doc_buckets), again, doc, tie, start)
                yield from _blocks(0, buckets, _bucket_of(h, buckets), ~again, doc, tie, start, h, check)
        _words.tidy()

    return run


def _blocks(kind: int, buckets: int, bucket: np.ndarray, keep: np.ndarray, doc, tie, start, *more):
    """One row for each bucket among the windows to keep, which come in the order of (doc, tie, start)."""
    pick = np.flatnonzero(keep)
    if not len(pick):
        return
    pick = pick[np.argsort(bucket[pick].astype(np.uint16 if bucket.max() < 1 << 16 else np.int64), kind="stable")]
    edges = np.r_[0, np.flatnonzero(np.diff(bucket[pick])) + 1, len(pick)]
    where, blocks = [], []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        part = pick[a:b]
        block = _pack(doc[part], tie[part], start[part], *(m[part] for m in more))
        where.append(int(bucket[part[0]]))
        blocks.append(block if kind == 0 else struct.pack("<q", where[-1]) + block)
    yield pa.RecordBatch.from_pydict({"bucket": pa.array([w % buckets for w in where], pa.int32()), "kind": pa.array([kind] * len(where), pa.int32()), "block": pa.array(blocks, pa.binary())})


def _merge(doc_buckets: int, fold: bool):
    """Reduce side, one bucket: looks the batch up in the runs (kind 2) and in itself. Kind 1 out: marked
    windows by document bucket; kind 2 out: the bucket's new hashes, sorted, with ``fold`` merged with those of
    all runs."""

    def run(table: pa.Table) -> pa.Table:
        fresh_h, fresh_c = np.empty(0, np.uint64), np.empty(0, np.uint32)
        bucket = table["bucket"][0].as_py()
        out_bucket, out_kind, out_block = [], [], []
        rows, history = [], []
        for kind, block in zip(table["kind"].to_pylist(), table["block"].to_pylist(), strict=True):
            if kind == 1:
                out_bucket.append(struct.unpack_from("<q", block)[0])
                out_kind.append(1)
                out_block.append(block[8:])
            elif kind == 2:
                history.append(block)
            else:
                rows.append(_unpack(block, np.uint64, np.uint32))
        if rows:
            doc, tie, start, h, check = (np.concatenate(c) for c in zip(*rows, strict=True))
            del rows
            order = _sorted(h, check, doc, tie, start)
            h, check, doc, tie, start = h[order], check[order], doc[order], tie[order], start[order]
            first, later = _first_and_later(h, check, doc, tie, start)
            old = np.zeros(len(h), bool)
            for block in history:
                old |= _found(*_entries(block), h, check) >= 0
            marked = np.flatnonzero(old | later)
            fresh = first & ~old
            if len(marked):
                marked = marked[np.lexsort((start[marked], tie[marked], doc[marked]))]
                d = _doc_bucket(doc[marked], doc_buckets)
                for part in _blocks(0, doc_buckets, d, np.ones(len(d), bool), doc[marked], tie[marked], start[marked]):
                    out_bucket += part["bucket"].to_pylist()
                    out_kind += [1] * len(part)
                    out_block += part["block"].to_pylist()
            fresh_h, fresh_c = h[fresh], check[fresh]
        if fold and history:
            fresh_h, fresh_c = _united([(fresh_h, fresh_c), *map(_entries, history)])
        if len(fresh_h):
            out_bucket.append(bucket)
            out_kind.append(2)
            out_block.append(_entry_block(fresh_h, fresh_c))
        return pa.table({"bucket": pa.array(out_bucket, pa.int32()), "kind": pa.array(out_kind, pa.int32()), "block": pa.array(out_block, pa.binary())})

    return run


def _united(entries: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Entries of one bucket in one order. They are disjoint: a run holds only what was new."""
    h, c = (np.concatenate(x) for x in zip(*entries, strict=True))
    order = np.lexsort((c, h))
    return h[order], c[order]


def _compact(table: pa.Table) -> pa.Table:
    """One bucket's runs as one sorted run."""
    block = _entry_block(*_united([_entries(b) for b in table["block"].to_pylist()]))
    return pa.table({"bucket": table["bucket"].slice(0, 1), "kind": table["kind"].slice(0, 1), "block": pa.array([block], pa.binary())})


BLOCKS = "bucket int, kind int, block binary"


class FingerprintIndex:
    """The runs of one index in its folder. ``buckets`` is fixed for the index's life: choose it for the text that
    the index is to hold."""

    def __init__(self, spark: SparkSession, buckets: int, doc_buckets: int, window: int = WINDOW, path: str | None = None, max_runs: int = MAX_RUNS):
        self.spark, self.buckets, self.doc_buckets, self.window = spark, buckets, doc_buckets, window
        self.max_runs = max_runs
        self.path = path or stage_path(spark, "index")
        self.runs: list[str] = []

    @classmethod
    def open(cls, spark: SparkSession, path: str, max_runs: int = MAX_RUNS) -> FingerprintIndex:
        """The index that another session may have written to ``path``."""
        text = "\n".join(r[0] for r in spark.read.text(f"{path}/manifest.json", wholetext=True).collect())
        found = json.loads(text)
        index = cls(spark, found["buckets"], found["doc_buckets"], found["window"], path, max_runs)
        index.runs = [f"{path}/{run}" for run in found["runs"]]
        return index

    def _publish(self, runs: list[str]) -> None:
        """The manifest with ``runs`` takes the place of the one before."""
        files, place = file_system(self.spark, f"{self.path}/manifest.json")
        made = file_system(self.spark, f"{self.path}/manifest-{uuid.uuid4().hex}.json")[1]
        out = files.create(made, True)
        state = {"buckets": self.buckets, "doc_buckets": self.doc_buckets, "window": self.window, "runs": [r.rsplit("/", 1)[1] for r in runs]}
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        files.delete(place, False)
        files.rename(made, place)
        self.runs = runs

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(BLOCKS).parquet(*paths)

    def ingest(self, batch: DataFrame, keep: bool = True) -> DataFrame:
        """Marked windows of ``batch`` (bucket, block), whose doc_ids must follow all earlier ones.
        ``keep=False`` doesn't add the batch to the index."""
        rows = batch.select("doc_id", batch["text"].cast("string").alias("text")).mapInArrow(_hash_windows(self.window, self.buckets, self.doc_buckets), BLOCKS)
        if self.runs:
            rows = rows.unionByName(self._read(self.runs))
        fold = keep and len(self.runs) >= self.max_runs
        found = rows.groupBy("bucket").applyInArrow(_merge(self.doc_buckets, fold), BLOCKS)
        path = f"{self.path}/batch-{uuid.uuid4().hex}"
        # Two folders, of as many files as there are tasks: rows of runs go on by bucket in a later shuffle.
        (found if keep else found.where("kind = 1")).withColumn("part", F.col("kind")).write.partitionBy("part").parquet(path)
        del rows, found
        free_shuffles(self.spark)
        if keep:
            run = f"{self.path}/run-{uuid.uuid4().hex}"
            files, place = file_system(self.spark, f"{path}/part=2")
            if files.exists(place):  # a batch may have no new windows
                files.rename(place, file_system(self.spark, run)[1])
                before = self.runs
                self._publish([run] if fold else [*before, run])
                for old in before if fold else []:
                    _delete(self.spark, old)
        files, place = file_system(self.spark, f"{path}/part=1")
        if files.exists(place):
            return self._read([f"{path}/part=1"]).select("bucket", "block")
        return self.spark.createDataFrame([], "bucket int, block binary")

    def compact(self) -> None:
        """All runs become one now: each bucket's runs are merged by one task."""
        if len(self.runs) < 2:
            return
        merged = f"{self.path}/run-{uuid.uuid4().hex}"
        self._read(self.runs).groupBy("bucket").applyInArrow(_compact, BLOCKS).write.parquet(merged)
        before = self.runs
        self._publish([merged])
        for run in before:
            _delete(self.spark, run)
        free_shuffles(self.spark)

    def drop(self) -> None:
        """Delete the runs; marked windows already returned stay."""
        before = self.runs
        self._publish([])
        for run in before:
            _delete(self.spark, run)


def _cut(window: int):
    """One document bucket: removes the words that marked windows cover."""

    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        blocks = [_unpack(b) for b in marks["block"].to_pylist()]
        doc, tie, start = (np.concatenate(c) for c in zip(*blocks, strict=True)) if blocks else (np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.uint32))
        order = np.lexsort((start, tie, doc))
        doc, tie, start = doc[order], tie[order], start[order].astype(np.int64)
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1])
        at = np.r_[np.flatnonzero(new), len(doc)]
        place = {(int(doc[a]), int(tie[a])): (a, b) for a, b in zip(at[:-1], at[1:], strict=True)}
        ids, ties, words_of = _ids(docs["doc_id"].combine_chunks()), _ties(docs["text"].combine_chunks()), docs["text"].combine_chunks().fill_null("").cast(pa.binary())
        n, gone, kept = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), []
        for i, text in enumerate(words_of):
            words = text.as_py().split()
            n[i] = len(words)
            span = place.get((int(ids[i]), int(ties[i])))
            if span:
                cover = np.zeros(len(words) + 1, np.int64)
                begin = np.unique(start[span[0] : span[1]])
                cover[begin] += 1
                np.subtract.at(cover, begin + window, 1)
                covered = np.cumsum(cover[:-1]) > 0
                gone[i] = covered.sum()
                words = [words[j] for j in np.flatnonzero(~covered)]
            kept.append(b" ".join(words))
        return pa.table({"doc_id": docs["doc_id"], "n_words": n, "n_removed": gone, "kept_text": pa.array(kept, pa.binary()).cast(pa.string())})

    return run


def remove_repeats(docs: DataFrame, *, window: int = WINDOW, batches: int = BATCHES, index: FingerprintIndex | None = None, digest_only: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_text (or with ``digest_only``
    its SHA-256, kept_sha256). With ``index``, its history counts as earlier, and it takes ``docs`` in."""
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    doc_buckets = parts_for(size, BUCKET_BYTES)
    own = index is None
    index = index or FingerprintIndex(spark, parts_for(size, 2 * BUCKET_BYTES), doc_buckets, window, max_runs=OWN_RUNS)
    doc_buckets = index.doc_buckets
    cuts = [i / batches for i in range(1, batches)]
    bounds = (docs.agg(F.percentile_approx("doc_id", F.array(*[F.lit(c) for c in cuts]), F.lit(10_000))).first()[0] or []) if cuts else []
    bounds = sorted(set(bounds))
    marks = None
    for i in range(len(bounds) + 1):
        part = docs
        if i < len(bounds):
            part = part.where((F.col("doc_id") <= bounds[i]) | (F.col("doc_id").isNull() if i == 0 else F.lit(False)))
        if i > 0:
            part = part.where(F.col("doc_id") > bounds[i - 1])
        found = index.ingest(part, keep=not own or i < len(bounds))
        marks = found if marks is None else marks.unionByName(found)
    if own:
        index.drop()

    doc_id = docs["doc_id"].cast("long")
    rows = docs.select(_doc_bucket_column(doc_id, doc_buckets).alias("bucket"), doc_id.alias("doc_id"), docs["text"].cast("string").alias("text"))
    cut = _cut(window)
    if not digest_only:
        return rows.groupBy("bucket").cogroup(marks.groupBy("bucket")).applyInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text string")

    def digested(docs_: pa.Table, marks_: pa.Table) -> pa.Table:
        out = cut(docs_, marks_)
        sha = [hashlib.sha256(t).hexdigest() for t in out["kept_text"].cast(pa.binary()).to_pylist()]
        return out.drop_columns("kept_text").append_column("kept_sha256", pa.array(sha, pa.string()))

    return rows.groupBy("bucket").cogroup(marks.groupBy("bucket")).applyInArrow(digested, "doc_id long, n_words long, n_removed long, kept_sha256 string")
