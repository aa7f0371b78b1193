"""Quality classifier: random Fourier features over document statistics, ridge, isotonic calibration.

A document's statistics (lengths, shares of kinds of characters, repetition of words, word pairs and
lines) are standardized and sent through FEATURES random cosines, which approximate a Gaussian kernel.
Partitions sum their parts of the normal equations; the sums give the ridge solution on one fold of the
labelled documents, and pooled adjacent violators on the other fold turn its output into probabilities.
Fitting uses at most ``most_rows`` labelled documents (200,000 unless given); every document is scored over its
whole text, without its labels, language, source or id.

Defined results: null and empty texts have zero statistics and are scored like any other; rows that
repeat a doc_id are scored each; a null doc_id is scored and not held out; labels that are null or differ for one
doc_id are left out; without labels every score is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import _words
from gleaner.llm._labels import TRAIN_ROWS, held_out, training_rows

FEATURES = 512
RIDGE = 1.0
SEED = 17
#: Numbers of a vector that are added up together.
SLICE = 1 << 13

_kinds = np.zeros((7, 256), bool)
for _b in range(128):
    _c = chr(_b)
    _kinds[0, _b] = _c.isupper()
    _kinds[1, _b] = _c.isdigit()
    _kinds[2, _b] = _c in ".,;:"
    _kinds[3, _b] = _c in "!?"
    _kinds[4, _b] = _c in "#$%&*+/<=>@\\^_`{|}~()[]-\"'"
    _kinds[5, _b] = _c == "\n"
    _kinds[6, _b] = _c in " \t\r"
STATISTICS = 9 + len(_kinds) + 5


def _per_document(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return sums[edges[1:]] - sums[edges[:-1]]


def _distinct(owner: np.ndarray, h: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the count of the commonest one, by document."""
    if not len(h):
        return np.zeros(docs), np.zeros(docs)
    keys = (owner.astype(np.uint64) << np.uint64(40)) | (h & np.uint64((1 << 40) - 1))
    keys, counts = np.unique(keys, return_counts=True)
    of = (keys >> np.uint64(40)).astype(np.int64)
    top = np.zeros(docs)
    np.maximum.at(top, of, counts)
    return np.bincount(of, minlength=docs).astype(float), top


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of STATISTICS numbers for each text."""
    docs = len(texts)
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    edges = np.r_[0, np.cumsum(sizes)]
    raw, starts, ends, first = _words.split(texts)
    words = _words.hashes(raw, starts, ends)
    count = np.diff(first)
    n, size = np.maximum(count, 1), np.maximum(sizes, 1)
    owner = np.repeat(np.arange(docs), count)
    length = (ends - starts).astype(float)
    same = owner[1:] == owner[:-1]
    pairs, pair_owner = _words.grams(words, 2)[same] if len(words) > 1 else np.empty(0, np.uint64), owner[:-1][same]
    out = [np.log1p(count), np.log1p(sizes)]
    mean = _per_document(length, first) / n
    out += [mean, np.sqrt(np.maximum(_per_document(length**2, first) / n - mean**2, 0)), np.log1p(_per_document(length > 20, first) / n)]
    kinds, top = _distinct(owner, words, docs)
    out += [kinds / n, top / n]
    two, top2 = _distinct(pair_owner, pairs, docs)
    m = np.maximum(count - 1, 1)
    out += [two / m, top2 / m]
    shares = [_per_document(k[raw], edges) / size for k in _kinds]
    out += shares
    again = words[1:] == words[:-1]
    lines = shares[5] * size + 1
    last = raw[ends - 1] if len(ends) else np.empty(0, np.uint8)
    initial = raw[starts] if len(starts) else np.empty(0, np.uint8)
    out += [
        np.bincount(owner[1:][same & again], minlength=docs) / m,
        np.log1p(count / lines),
        _per_document(_kinds[4][last] | _kinds[3][last], first) / n,
        _per_document(_kinds[4][initial], first) / n,
        _per_document(raw >= 128, edges) / size,
    ]
    return np.column_stack(out)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    turns: np.ndarray
    phases: np.ndarray
    weights: np.ndarray | None = None
    steps: tuple[np.ndarray, np.ndarray] | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.turns + self.phases), np.ones((len(x), 1))])

    def output(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Isotonic steps, joined by lines; a thousandth of the raw output keeps equals in order."""
        if self.weights is None or self.steps is None:
            return np.full(len(x), 0.5)
        y = self.output(x)
        return 0.999 * np.interp(y, *self.steps) + 0.001 / (1 + np.exp(-np.clip(y, -30, 30)))


def _sums(rows: DataFrame, size: int, part) -> np.ndarray:
    """The sum over partitions of the vectors that ``part(batch)`` gives. Each partition of the sample sends one
    vector in slices, which are added up by slice on the executors."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            for a, b in _words.slices(batch["text"]):
                total += part(batch.slice(a, b - a))
        for i in range(0, size, SLICE):
            yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int32()), "v": pa.array([total[i : i + SLICE].tobytes()], pa.binary())})

    def added(table: pa.Table) -> pa.Table:
        # Sorted, so that a rerun adds in the same order.
        vectors = [np.frombuffer(v) for v in sorted(table["v"].to_pylist())]
        return pa.table({"i": table["i"].slice(0, 1), "v": pa.array([np.sum(vectors, axis=0).tobytes()], pa.binary())})

    sums = rows.mapInArrow(run, "i int, v binary").groupBy("i").applyInArrow(added, "i int, v binary").toArrow()
    out = np.zeros(size)
    for i, v in zip(sums["i"].to_pylist(), sums["v"].to_pylist(), strict=True):
        out[i : i + SLICE] = np.frombuffer(v)
    return out


def pooled(output: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling adjacent violators: (places, values) to interpolate."""
    order = np.argsort(output, kind="stable")
    blocks: list[list[float]] = []  # weight, sum of labels, sum of places
    for x, y, w in zip(output[order], label[order], weight[order], strict=True):
        blocks.append([w, w * y, w * x])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    w, y, x = np.array(blocks).T
    return x / w, y / w


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", *, most_rows: int = TRAIN_ROWS) -> Model:
    """A model of ``label`` from at most ``most_rows`` rows of ``labels`` that aren't held out."""
    rows = training_rows(docs, labels, label, most_rows)
    rng = np.random.default_rng(SEED)

    def moments(batch):
        x, w = statistics(batch["text"]), batch["weight"].to_numpy(zero_copy_only=False)
        return np.r_[w.sum(), w @ x, w @ x**2]

    m = _sums(rows, 1 + 2 * STATISTICS, moments)
    n = max(m[0], 1e-9)
    mean = m[1 : 1 + STATISTICS] / n
    scale = np.sqrt(np.maximum(m[1 + STATISTICS :] / n - mean**2, 1e-12)) + 1e-6
    width = np.sqrt(STATISTICS)
    model = Model(mean, scale, rng.standard_normal((STATISTICS, FEATURES)) / width, rng.uniform(0, 2 * np.pi, FEATURES))
    if not m[0]:
        return model
    d = FEATURES + 1

    def equations(batch):
        z = model.features(statistics(batch["text"]))
        w, y = (batch[c].to_numpy(zero_copy_only=False).astype(float) for c in ("weight", "label"))
        return np.r_[(z.T @ (z * w[:, None])).ravel(), z.T @ (w * y)]

    e = _sums(rows.where("fold = 0"), d * d + d, equations)
    model.weights = np.linalg.solve(e[: d * d].reshape(d, d) + RIDGE * np.eye(d), e[d * d :])

    def outputs(batches):
        for batch in batches:
            for a, b in _words.slices(batch["text"]):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([pa.array(model.output(statistics(part["text"]))), part["label"], part["weight"]], ["output", "label", "weight"])

    seen = rows.where("fold = 2").select("text", "label", "weight").mapInArrow(outputs, "output double, label int, weight double").toArrow()
    if len(seen):
        model.steps = pooled(*(seen[c].to_numpy().astype(float) for c in ("output", "label", "weight")))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: doc_id, score."""

    def run(batches):
        for batch in batches:
            for a, b in _words.slices(batch["text"]):
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), pa.array(model.probability(statistics(batch["text"].slice(a, b - a))))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, most_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    out = score(docs, learn(docs, labels, most_rows=most_rows))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
