"""Related-document packing: tokens into sequences of at most ``length``, neighbours together.

A document's sketch is a small vector of its word counts; documents with equal sketches are one node. Nodes get
their NEIGHBOURS nearest others by an inverted-file search over all of them: cells around centroids of a bounded
sample, every node in the cell of its nearest centroid, and every node compared with all members of the cells
nearest to it. Cells grow in number with the nodes and the cells searched with the root of their number,
so the search costs the 1.5th power of the nodes; its recall is measured in the tests and in the README.

Cells, in an order that leads from each to a near one, are cut into ranges of bounded bytes of text, one task each. A greedy walk
starts at the unvisited node of lowest degree and goes on to its nearest unvisited neighbour until there is none in
its range; the paths, one after another, fill windows of ``length`` tokens. Links to nodes of other ranges
count for no path. The rest of a range's stream is cut into sequences of powers of two, which need no
padding at all.

Defined results: a null text is empty and has the end token alone; repeated rows are packed as rows of
their own; a null doc_id comes first within equal sketches; other columns don't matter; an empty table
gives an empty result.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import _words
from gleaner.llm._common import parts_for, stage

SKETCH = 64
NEIGHBOURS = 8
#: Nodes, the first by a hash, to which the cells are fitted; cells at most; cells searched, times the root of their number.
SAMPLE, MOST_CELLS, PROBE = 20_000, 4_096, 1.5
END_ID = 1
#: Units whose ids are kept; beyond that the memory starts afresh.
MEMO = 300_000
TABLE_BITS = 20
#: Queries of a cell in one product; hits that gather before they are sorted.
STEP, MOST_HITS = 512, 1 << 18
#: Hashes of units for the library are set apart by this.
ODD = 0x5851F42D4C957F2D


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One for each Python worker, whatever the number of its tasks."""
    return Encoder(path)


class Encoder:
    """Token ids of texts for a tokenizer whose pre-tokenizer never joins across white space.

    Where the tokenizer file holds the pipeline that this class knows (lower case, word ends, no dropout), texts
    are cut into its pieces by numpy, byte by byte: runs of ASCII and Latin-1 letters, single digits, runs of other
    ASCII signs, and contractions. The ids of each piece are kept by its hash. A word with anything else in it is
    a unit that goes through the library, as do all texts with any other tokenizer.
    """

    _PIECES = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()
        spec = json.loads(Path(path).read_text())
        self.fast = self._known(spec)
        if self.fast:
            self._load(spec)

    def _known(self, spec: dict) -> bool:
        try:
            steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
            split, level = spec["pre_tokenizer"]["pretokenizers"]
            model = spec["model"]
            return (
                steps == ["NFC", "Replace", "Lowercase"]
                and split["pattern"] == {"Regex": self._PIECES}
                and split["behavior"] == "Removed"
                and split["invert"]
                and level["type"] == "ByteLevel"
                and not level["add_prefix_space"]
                and not level["use_regex"]
                and model["type"] == "BPE"
                and model["end_of_word_suffix"] == "</w>"
                and not (model["dropout"] or model["continuing_subword_prefix"] or model["ignore_merges"] or model["byte_fallback"])
                and len(model["vocab"]) < 1 << 16
            )
        except (KeyError, TypeError, ValueError):
            return False

    def _load(self, spec: dict) -> None:
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        # The byte level writes printable bytes as themselves and the others from code point 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        letter = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.inner = np.array([vocab[letter[b]] for b in range(256)], np.int64)
        self.final = np.array([vocab[letter[b] + "</w>"] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        # Places of pairs by hash; the few that share a cell are in a second table.
        self.tables = []
        left = np.arange(len(keys))
        for multiplier in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            table = np.full(1 << TABLE_BITS, len(keys), np.int32)
            cell = self._cell(self.keys[left], multiplier)
            table[cell] = left
            self.tables.append((multiplier, table))
            left = left[table[cell] != left]
        self.rest = left
        self.keys, self.ranks = np.append(self.keys, -1), np.append(self.ranks, len(keys))

    @staticmethod
    def _cell(keys: np.ndarray, multiplier: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(multiplier)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def _place(self, key: np.ndarray) -> np.ndarray:
        """The place of each pair among the merges; the last place is for pairs that never merge."""
        none = len(self.keys) - 1
        (first, table), (second, more) = self.tables
        at = table[self._cell(key, first)]
        miss = np.flatnonzero((self.keys[at] != key) & (at != none))
        at[miss] = more[self._cell(key[miss], second)]
        miss = miss[self.keys[at[miss]] != key[miss]]
        at[miss] = none
        for place in self.rest.tolist():
            at[miss[key[miss] == self.keys[place]]] = place
        return at

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _merge(self, raw: list[bytes]) -> list[bytes]:
        """Byte pairs of all pieces at once: in each round, every piece merges its lowest-ranked pair."""
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbol, piece = self.inner[data], np.repeat(np.arange(len(raw)), length)
        last = np.cumsum(length) - 1
        symbol[last] = self.final[data[last]]
        never = len(self.keys) - 1
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            at = self._place(symbol[:-1] << 16 | symbol[1:])
            rank = np.append(np.where(piece[1:] == piece[:-1], self.ranks[at], never), never)
            begin = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
            size = np.diff(np.r_[begin, len(piece)])
            best = np.repeat(np.minimum.reduceat(rank, begin), size)
            over = best == never
            done.append((piece[over], symbol[over]))
            hit = (rank == best) & ~over
            # Of overlapping equal pairs, every other one from the left.
            where = np.flatnonzero(hit)
            if len(where):
                lead = np.r_[True, np.diff(where) > 1]
                where = where[(where - where[lead][np.cumsum(lead) - 1]) % 2 == 0]
                symbol[where] = self.made[at[where]]
                over[where + 1] = True
            symbol, piece = symbol[~over], piece[~over]
        piece, symbol = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(piece, kind="stable")
        ids = symbol[order].astype("<u4").tobytes()
        ends = (np.cumsum(np.bincount(piece, minlength=len(raw))) * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def forget(self) -> None:
        """Gives the memory back: the worker may go on to other stages."""
        self.known, self.at, self.size, self.pool = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, "<u4")

    def settle(self) -> None:
        """Forgets a large memory: the worker may go on to other stages."""
        if len(self.known) > MEMO // 2:
            self.forget()

    def _learn(self, hashes: np.ndarray, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, odd: np.ndarray) -> None:
        """Adds units to those known."""
        if len(self.known) > MEMO:
            self.forget()
        made: list[bytes] = [b""] * len(hashes)
        units = [low[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        for picked, encode in ((np.flatnonzero(~odd), self._merge), (np.flatnonzero(odd), lambda u: self._library([x.decode() for x in u]))):
            if len(picked):
                for i, ids in zip(picked.tolist(), encode([units[i] for i in picked.tolist()]), strict=True):
                    made[i] = ids
        size = np.fromiter(map(len, made), np.int64, len(made)) // 4
        known = np.r_[self.known, hashes]
        order = np.argsort(known, kind="stable")
        at = np.r_[self.at, len(self.pool) + np.cumsum(size) - size]
        self.pool = np.r_[self.pool, np.frombuffer(b"".join(made), "<u4")]
        self.known, self.at, self.size = known[order], at[order], np.r_[self.size, size][order]

    def block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): text i has the token ids first[i] .. first[i+1]-1. A null text has none."""
        if not self.fast:
            made = self._library([t or "" for t in texts.to_pylist()])
            return np.frombuffer(b"".join(made), "<u4"), np.r_[0, np.cumsum([len(m) // 4 for m in made], dtype=np.int64)]
        low, starts, ends, odd, first = _units(texts)
        if not len(starts):
            return np.empty(0, "<u4"), np.zeros(len(texts) + 1, np.int64)
        hashes = _words.hashes(low, starts, ends)
        hashes[odd] ^= np.uint64(ODD)
        distinct, one, which = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.known, distinct), max(len(self.known) - 1, 0))
        new = self.known[place] != distinct if len(self.known) else np.ones(len(distinct), bool)
        if new.any():
            if len(self.known) > MEMO:
                new[:] = True
            of = one[new]
            self._learn(distinct[new], low, starts[of], ends[of], odd[of])
            place = np.searchsorted(self.known, distinct)
        size = self.size[place][which]
        stop = np.cumsum(size)
        from_ = np.repeat(self.at[place][which] - (stop - size), size)
        ids = self.pool[from_ + np.arange(len(from_))]
        return ids, np.r_[0, stop][first]


_BLANK, _LETTER, _DIGIT, _SIGN, _ODD = range(5)
_class = np.full(256, _ODD, np.uint8)
_class[[9, 10, 11, 12, 13, 32]] = _BLANK
for _b in range(33, 127):
    _class[_b] = _LETTER if chr(_b).isalpha() else _DIGIT if chr(_b).isdigit() else _SIGN
#: Second bytes of Latin-1 letters after 0xC3, and what lower case makes of them.
_latin = np.zeros(256, bool)
_latin[0x80:0xC0] = True
_latin[[0x97, 0xB7]] = False
_latin_low = np.arange(256, dtype=np.uint8)
_latin_low[0x80:0x9F] += 32
_latin_low[0x97] = 0x97
_low = np.arange(256, dtype=np.uint8)
_low[65:91] += 32


def _units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, odd, first): text i has the units first[i] .. first[i+1]-1, which are pieces in lower
    case or, where odd, whole words as they are."""
    texts = texts.fill_null("").cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    edges = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data is not None and edges[-1] > edges[0] else np.empty(0, np.uint8)
    edges = edges - edges[0]
    n = len(raw)
    kind, low = _class[raw], _low[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3) if n else np.empty(0, np.int64)
    lead = lead[_latin[raw[lead + 1]]]
    kind[lead] = kind[lead + 1] = _LETTER
    low[lead + 1] = _latin_low[raw[lead + 1]]
    full = kind != _BLANK
    edge = np.zeros(n + 1, bool)
    edge[edges] = True
    begin = full & edge[:n]
    begin[1:] |= full[1:] & ~full[:-1]
    # Words with other characters, or that may hold a special token, stay whole.
    word = np.cumsum(begin) - 1
    strange = kind == _ODD
    strange[:-1] |= (raw[:-1] == 0x3C) & (raw[1:] == 0x7C) & ~edge[1:n]
    whole = np.zeros(int(begin.sum()), bool)
    whole[word[strange]] = True
    in_odd = full & whole[np.maximum(word, 0)] if len(whole) else np.zeros(n, bool)
    low[in_odd] = raw[in_odd]
    start = full & (kind == _DIGIT)
    start[1:] |= full[1:] & (kind[1:] != kind[:-1])
    start = start & ~in_odd | begin
    stop = ~full | edge[:n]  # where no unit goes on
    # An apostrophe that begins a run of signs takes 's, 't, 'm, 'd, 're, 've or 'll with it.
    for p in _contractions(raw, low, start & (raw == 0x27) & ~in_odd, stop):
        at, length = p
        start[at + 1] = False
        after = at + length
        after = after[after < n]
        start[after[full[after] & ~stop[after]]] = True
    cut = np.flatnonzero(start | stop)
    mine = start[cut]
    starts, ends = cut[mine], np.r_[cut[1:], n][mine]
    return low, starts, ends, in_odd[starts], np.searchsorted(starts, edges)


def _contractions(raw: np.ndarray, low: np.ndarray, candidates: np.ndarray, stop: np.ndarray):
    """(places, length) of the apostrophes that begin a contraction."""
    at = np.flatnonzero(candidates)
    at = at[at + 1 < len(raw)]
    at = at[~stop[at + 1]]
    one = at[np.isin(low[at + 1], np.frombuffer(b"stmd", np.uint8))]
    two = at[at + 2 < len(raw)]
    two = two[~stop[two + 2]]
    pair = low[two + 1].astype(np.int64) << 8 | low[two + 2]
    two = two[np.isin(pair, [a << 8 | b for a, b in (b"re", b"ve", b"ll")])]
    return ((one, 2), (two, 3))


def sketches(texts: pa.Array) -> np.ndarray:
    """A unit vector of SKETCH signed, square-rooted counts of hashed words for each text."""
    out = np.zeros((len(texts), SKETCH), np.float32)
    for a, b in _words.slices(texts):
        raw, starts, ends, first = _words.split(texts.slice(a, b - a), lower=True)
        h = _words.hashes(raw, starts, ends)
        owner = np.repeat(np.arange(b - a), np.diff(first))
        cell = owner * SKETCH + (h % np.uint64(SKETCH)).astype(np.int64)
        sign = 1.0 - 2.0 * ((h >> np.uint64(40)) & np.uint64(1)).astype(np.float64)
        sums = np.bincount(cell, sign, (b - a) * SKETCH).reshape(-1, SKETCH)
        out[a:b] = np.sign(sums) * np.sqrt(np.abs(sums))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def quantized(texts: pa.Array) -> np.ndarray:
    """Sketches in whole numbers of a byte."""
    return np.round(sketches(texts) * 127).astype(np.int8)


def node_ids(sketch: np.ndarray) -> np.ndarray:
    """A number for each row of quantized sketches."""
    h = np.zeros(len(sketch), np.uint64)
    for part in np.ascontiguousarray(sketch).view(np.uint64).T:
        h = _words.mixed((h ^ part) + np.uint64(_words.BASE))
    return h.view(np.int64)


def _vectors(blobs: list[bytes]) -> np.ndarray:
    """Unit vectors of quantized sketches."""
    v = np.frombuffer(b"".join(blobs), np.int8).reshape(-1, SKETCH).astype(np.float32)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def fit_cells(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Centroids of ``sample`` (unit vectors) by spherical k-means, in an order that leads from each to a near one."""
    cells = max(1, min(cells, len(sample)))
    centroids = sample[np.linspace(0, len(sample) - 1, cells).astype(int)] if len(sample) else np.zeros((1, SKETCH), np.float32)
    for _ in range(rounds if len(sample) else 0):
        sums = np.zeros_like(centroids)
        np.add.at(sums, (sample @ centroids.T).argmax(1), sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 0, sums / np.maximum(norm, 1e-9), centroids)
    left = np.ones(cells, bool)
    order, now = [], 0
    while len(order) < cells:
        order.append(now)
        left[now] = False
        now = int(np.where(left, centroids @ centroids[now], -2).argmax())
    return centroids[order]


class Layout:
    """Where nodes go: the cells of the search, and the ranges of cells that are packed together."""

    def __init__(self, centroids: np.ndarray, probes: int):
        self.centroids, self.probes = centroids, min(probes, len(centroids))
        near = centroids @ centroids.T
        np.fill_diagonal(near, 2)
        #: A cell's members are candidates in all cells that have it among the nearest; twice as many as one node searches.
        self.reach: list[list[int]] = [[] for _ in centroids]
        for cell, best in enumerate(np.argsort(-near, axis=1)[:, : 2 * self.probes].tolist()):
            for other in best:
                self.reach[other].append(cell)
        self.first, self.parts = np.zeros(len(centroids), np.int64), np.ones(len(centroids), np.int64)
        self.heavy: dict[int, tuple[int, int]] = {}
        self.ranges = 1

    def cut(self, cell_bytes: dict[int, int], heavy: dict[int, int], range_bytes: int) -> None:
        """Ranges of about ``range_bytes``: cells in their order, large ones and copies of one text split."""
        total = at = 0
        for cell in range(len(self.centroids)):
            size = cell_bytes.get(cell, 0)
            if total and total + size > range_bytes:
                at, total = at + 1, 0
            self.first[cell], self.parts[cell] = at, parts_for(size, range_bytes)
            at, total = at + self.parts[cell] - 1, total + size
            if self.parts[cell] > 1:
                at, total = at + 1, 0
        self.ranges = at + 1
        for node, size in sorted(heavy.items()):
            self.heavy[node] = (self.ranges, parts_for(size, range_bytes))
            self.ranges += self.heavy[node][1]

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        return np.concatenate([(vectors[i : i + 4096] @ self.centroids.T).argmax(1) for i in range(0, max(len(vectors), 1), 4096)])

    def range_of(self, cell: np.ndarray, node: np.ndarray) -> np.ndarray:
        return self.first[cell] + node % self.parts[cell]


def _nodes(docs: DataFrame) -> DataFrame:
    """Staged: sketch and bytes of text of each node."""

    def run(batches):
        for batch in batches:
            sketch = quantized(batch["text"])
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in sketch], pa.binary()), pc.fill_null(pc.binary_length(batch["text"]), 0).cast(pa.int64())], ["sketch", "bytes"])
        _words.tidy()

    made = docs.select(docs["text"].cast("string").alias("text")).mapInArrow(run, "sketch binary, bytes long")
    return stage(made.groupBy("sketch").agg(F.sum("bytes").alias("bytes")), "nodes", reclaim=True)


def _members(layout: Layout):
    """Packed members of cells: for each cell that searches them, (cell, home, ids, sketches)."""

    def run(batches):
        for batch in batches:
            blobs = batch["sketch"].to_pylist()
            if not blobs:
                continue
            sketch = np.frombuffer(b"".join(blobs), np.int8).reshape(-1, SKETCH)
            ids, home = node_ids(sketch), layout.cells(_vectors(blobs))
            for h in np.unique(home).tolist():
                mine = np.flatnonzero(home == h)
                for a in range(0, len(mine), 2048):
                    part = mine[a : a + 2048]
                    to = layout.reach[h]
                    blocks = [pa.array([x] * len(to), pa.binary()) for x in (ids[part].tobytes(), sketch[part].tobytes())]
                    yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([h] * len(to), pa.int32()), *blocks], ["cell", "home", "ids", "sketches"])

    return run


class _Best:
    """The best neighbours of each query so far; hits gather until there are many."""

    def __init__(self, n: int, neighbours: int):
        self.ids, self.alike = np.full((n, neighbours), -1, np.int64), np.full((n, neighbours), -2, np.float32)
        self.hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.count = 0

    def add(self, rows: np.ndarray, ids: np.ndarray, alike: np.ndarray) -> None:
        self.hits.append((rows, ids, alike))
        self.count += len(rows)
        if self.count > MOST_HITS:
            self.settle()

    def settle(self) -> None:
        if not self.hits:
            return
        row, who, how = (np.concatenate(c) for c in zip(*self.hits, strict=True))
        self.hits, self.count = [], 0
        touched = np.unique(row)
        k = self.ids.shape[1]
        row = np.r_[row, np.repeat(touched, k)]
        who, how = np.r_[who, self.ids[touched].ravel()], np.r_[how, self.alike[touched].ravel()]
        order = np.argsort(row * 8.0 - how, kind="stable")  # likeness lies within 2
        row, who, how = row[order], who[order], how[order]
        rank = np.arange(len(row)) - np.searchsorted(row, touched)[np.searchsorted(touched, row)]
        best = rank < k
        self.ids[row[best], rank[best]], self.alike[row[best], rank[best]] = who[best], how[best]


def nearest(queries: np.ndarray, own: np.ndarray, blocks: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], neighbours: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, likeness): the best neighbours of each query among the other queries and blocks of (ids, vectors, rows of
    the queries that search it), best first; -1 for none."""
    n = len(queries)
    found = _Best(n, neighbours)
    for a in range(0, n, STEP):
        near = queries[a : a + STEP] @ queries.T
        rows = np.arange(len(near))
        near[rows, a + rows] = -2
        k = min(neighbours, n - 1)
        if k:
            top = np.argpartition(near, n - k, axis=1)[:, n - k :]
            found.add(np.repeat(a + rows, k), own[top.ravel()], np.take_along_axis(near, top, 1).ravel())
    found.settle()
    for their, vectors, rows in blocks:
        turned = np.ascontiguousarray(vectors.T)
        for a in range(0, len(rows), STEP):
            part = rows[a : a + STEP]
            near = queries[part] @ turned
            hit = np.flatnonzero(near > found.alike[part, -1:])
            r, c = np.divmod(hit, len(their))
            found.add(part[r], their[c], near.ravel()[hit])
    found.settle()
    return found.ids, found.alike


def _near(layout: Layout, neighbours: int):
    """One cell: the nearest neighbours of its own nodes among the members that reached it."""

    def run(table: pa.Table) -> pa.Table:
        cell = table["cell"][0].as_py()
        members: dict[int, tuple[list[bytes], list[bytes]]] = {}
        for home, ids, sketch in zip(table["home"].to_pylist(), table["ids"].to_pylist(), table["sketches"].to_pylist(), strict=True):
            kept = members.setdefault(home, ([], []))
            kept[0].append(ids)
            kept[1].append(sketch)
        if cell not in members:
            return pa.table({"range": pa.array([], pa.int32()), "node": pa.array([], pa.int64()), "near": pa.array([], pa.binary()), "alike": pa.array([], pa.binary())})
        own, queries = np.frombuffer(b"".join(members[cell][0]), np.int64), _vectors(members[cell][1])
        order = np.argsort(own)
        own, queries = own[order], queries[order]
        homes = np.array([cell, *sorted(members.keys() - {cell})])
        close = queries @ layout.centroids[homes].T
        close[:, 0] = 2
        rank = np.argsort(np.argsort(-close, axis=1, kind="stable"), axis=1, kind="stable")
        blocks = ((np.frombuffer(b"".join(members[h][0]), np.int64), _vectors(members[h][1]), np.flatnonzero(rank[:, i] < layout.probes)) for i, h in enumerate(homes.tolist()) if i)
        ids, alike = nearest(queries, own, blocks, neighbours)
        at = layout.range_of(np.full(len(own), cell), own)
        return pa.table({"range": pa.array(at, pa.int32()), "node": own, "near": pa.array([x.tobytes() for x in ids], pa.binary()), "alike": pa.array([x.tobytes() for x in alike], pa.binary())})

    return run


def graph(docs: DataFrame, *, neighbours: int = NEIGHBOURS, cell_nodes: int = 2_000, probe: float = PROBE, range_bytes: int = 16 << 20) -> tuple[DataFrame, Layout]:
    """The nearest-neighbour graph of ``docs``: (range, node, near, alike), staged, and its layout. ``probe`` times the root of the
    number of cells is how many a node searches."""
    nodes = _nodes(docs)
    n = nodes.count()
    sample = nodes.orderBy(F.xxhash64("sketch"), "sketch").limit(SAMPLE).select("sketch").toArrow()["sketch"].to_pylist()
    cells = min(MOST_CELLS, parts_for(n, cell_nodes))
    layout = Layout(fit_cells(_vectors(sample), cells), parts_for(probe * cells**0.5, 1))

    def loads(batches):
        for batch in batches:
            size = batch["bytes"].to_numpy()
            light = size <= range_bytes
            cell = layout.cells(_vectors(batch["sketch"].to_pylist())) if len(batch) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_pydict({"cell": pa.array(np.where(light, cell, -1), pa.int32()), "node": pa.array(np.where(light, 0, node_ids(np.frombuffer(b"".join(batch["sketch"].to_pylist()), np.int8).reshape(-1, SKETCH))), pa.int64()), "bytes": pa.array(size)})

    # A row for each cell, and for each node of more than range_bytes: fewer than there are ranges.
    found = nodes.mapInArrow(loads, "cell int, node long, bytes long").groupBy("cell", "node").agg(F.sum("bytes").alias("bytes")).collect()
    layout.cut({r["cell"]: r["bytes"] for r in found if r["cell"] >= 0}, {r["node"]: r["bytes"] for r in found if r["cell"] < 0}, range_bytes)
    members = nodes.select("sketch").mapInArrow(_members(layout), "cell int, home int, ids binary, sketches binary")
    made = members.groupBy("cell").applyInArrow(_near(layout, neighbours), "range int, node long, near binary, alike binary")
    return stage(made, "graph", reclaim=True), layout


def walk(n: int, near: np.ndarray, alike: np.ndarray) -> list[int]:
    """The order of visit of nodes 0 .. n-1: greedy paths over their links, lowest degree first. ``near`` has
    the neighbours of each node, -1 for none."""
    row, column = np.nonzero(near >= 0)
    other, score = near[row, column], alike[row, column]
    pair = np.unique(np.minimum(row, other) * n + np.maximum(row, other), return_index=True)[1]
    a, b, s = np.r_[row[pair], other[pair]], np.r_[other[pair], row[pair]], np.r_[score[pair], score[pair]]
    order = np.lexsort((b, -s, a))
    links = b[order].tolist()
    edge = np.searchsorted(a[order], np.arange(n + 1))
    lowest = np.argsort(np.diff(edge), kind="stable").tolist()
    edge = edge.tolist()
    seen, out = [False] * n, []
    for i in lowest:
        while not seen[i]:
            seen[i] = True
            out.append(i)
            i = next((j for j in links[edge[i] : edge[i + 1]] if not seen[j]), i)
    return out


def _ranged(layout: Layout):
    """Documents with their node and range. Copies of one text beyond a range's bytes are dealt to ranges of their own."""

    def run(batches):
        for batch in batches:
            sketch = quantized(batch["text"])
            node = node_ids(sketch) if len(sketch) else np.empty(0, np.int64)
            at = layout.range_of(layout.cells(_vectors([sketch.tobytes()])), node) if len(sketch) else node
            if layout.heavy:
                for i in np.flatnonzero(np.isin(node, list(layout.heavy))).tolist():
                    first, parts = layout.heavy[int(node[i])]
                    at[i] = first + (hash(batch["doc_id"][i].as_py()) + i) % parts
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(node), batch["doc_id"], batch["text"]], ["range", "node", "doc_id", "text"])

    return run


class _Filler:
    """Cuts a stream of documents into sequences; yields rows (doc, start, part, of, sequence, offset)."""

    def __init__(self, length: int, base: int):
        self.length, self.sequence, self.fill, self.base = length, 0, 0, base
        self.open: list[tuple] = []

    def _close(self) -> None:
        self.sequence, self.fill = self.sequence + 1, 0

    def add(self, doc, ids: bytes) -> Iterator[tuple]:
        n, at = len(ids) // 4, 0
        while at < n:
            take = min(n - at, self.length - self.fill)
            self.open.append((doc, at, ids[4 * at : 4 * (at + take)], n))
            self.fill, at = self.fill + take, at + take
            if self.fill == self.length:
                yield from self._rows(self.open)
                self.open = []
                self._close()

    def _rows(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc, at, part, n in pieces:
            yield doc, at, part, n, self.base + self.sequence, offset
            offset += len(part) // 4

    def end(self) -> Iterator[tuple]:
        """The last window, cut into powers of two from the largest."""
        pieces, left = self.open, self.fill
        self.open = []
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            mine = []
            while size:
                doc, at, part, n = pieces.pop(0)
                take = min(size, len(part) // 4)
                mine.append((doc, at, part[: 4 * take], n))
                if 4 * take < len(part):
                    pieces.insert(0, (doc, at + take, part[4 * take :], n))
                size -= take
            yield from self._rows(mine)
            self._close()


SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
DIGEST = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _order(docs: pa.Table, links: pa.Table) -> np.ndarray:
    """The order of a range's documents: nodes along their paths, within a node by doc_id, nulls first."""
    ids = docs["doc_id"].combine_chunks()
    missing = pc.is_valid(ids).to_numpy(zero_copy_only=False).astype(np.int8)
    nodes, of = np.unique(docs["node"].to_numpy(), return_inverse=True)
    near = np.full((len(nodes), NEIGHBOURS), -1, np.int64)
    alike = np.zeros((len(nodes), NEIGHBOURS), np.float32)
    if len(links):
        mine = links["node"].to_numpy()
        there, scores = (np.frombuffer(b"".join(links[c].to_pylist()), k).reshape(len(mine), -1) for c, k in (("near", np.int64), ("alike", np.float32)))
        row = np.minimum(np.searchsorted(nodes, mine), len(nodes) - 1)
        at = np.minimum(np.searchsorted(nodes, there), len(nodes) - 1)
        inside = nodes[at] == there  # links to other ranges lead to no path here
        known = nodes[row] == mine
        near[row[known]], alike[row[known]] = np.where(inside, at, -1)[known], scores[known]
    place = np.empty(len(nodes), np.int64)
    place[walk(len(nodes), near, alike)] = np.arange(len(nodes))
    return np.lexsort((ids.fill_null(0).to_numpy(), missing, place[of]))


def _pack(tokenizer: str, length: int, block_bytes: int, digest_only: bool):
    def table_of(rows: list[tuple]) -> pa.Table:
        doc, at, part, n, sequence, offset = zip(*rows, strict=True) if rows else ((),) * 6
        content = pa.array([zlib.crc32(p) for p in part], pa.int64()) if digest_only else pa.array(part, pa.binary())
        columns = [pa.array(doc, pa.int64()), pa.array(at, pa.int64()), pa.array([len(p) // 4 for p in part], pa.int64()), content, pa.array(n, pa.int64()), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())]
        return pa.Table.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32" if digest_only else "ids", "doc_tokens", "sequence_id", "offset"])

    def run(docs: pa.Table, links: pa.Table) -> pa.Table:
        if not len(docs):
            return table_of([])
        encode = _encoder(tokenizer)
        filler = _Filler(length, docs["range"][0].as_py() << 32)
        end = np.array([END_ID], "<u4").tobytes()
        order = _order(docs, links)
        ids, texts = docs["doc_id"].combine_chunks().take(pa.array(order)).to_pylist(), docs["text"]
        out: list[pa.Table] = []
        size = pc.fill_null(pc.binary_length(texts), 0).combine_chunks().to_numpy()[order]
        step = np.r_[0, np.flatnonzero(np.diff(np.cumsum(size) // block_bytes)) + 1, len(order)]
        for a, b in zip(step[:-1].tolist(), step[1:].tolist(), strict=True):
            part = texts.take(pa.array(order[a:b])).combine_chunks()
            tokens, first = encode.block(part)
            rows: list[tuple] = []
            for i in range(b - a):
                rows += filler.add(ids[a + i], tokens[first[i] : first[i + 1]].tobytes() + end)
            out.append(table_of(rows))
        out.append(table_of(list(filler.end())))
        encode.settle()
        _words.tidy()
        return pa.concat_tables(out)

    return run


def pack(docs: DataFrame, tokenizer: str, *, length: int = 2048, range_bytes: int = 16 << 20, block_bytes: int = 2 << 20, cell_nodes: int = 2_000, probe: float = PROBE, digest_only: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian 32-bit; with ``digest_only`` their
    CRC-32, ids_crc32), doc_tokens, sequence_id, offset."""
    links, layout = graph(docs, cell_nodes=cell_nodes, probe=probe, range_bytes=range_bytes)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    placed = rows.mapInArrow(_ranged(layout), "range int, node long, doc_id long, text string")
    return placed.groupBy("range").cogroup(links.groupBy("range")).applyInArrow(_pack(tokenizer, length, block_bytes, digest_only), DIGEST if digest_only else SCHEMA)
