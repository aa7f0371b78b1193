"""Toxicity by maximum-scoring segments over token log-odds.

Tokens are lower-case runs of letters and digits; besides the word itself, its first five and first
four characters are units, so that inflected forms share evidence. From labelled documents, each unit
gets the log-odds of its share in toxic documents with a Dirichlet prior centred on the share of the
next shorter unit (at the root: even odds), shifted down so that ordinary text drifts below zero.
A linear-time scan (Ruzzo and Tompa) finds every maximal scoring segment of a document. Under the
extreme-value law a clean document of n tokens has a segment of score S or more with
1 - exp(-K n e^(-lambda S)); lambda solves the score distribution of clean tokens, K is fitted to the best
segments of clean documents. Segments above chance, lambda S > ln(K n), are the toxic passages; their
excess is summed and turned into a probability by a logistic curve fitted on a fold of the labelled
documents that the units for it didn't see.

At most ``most_rows`` labelled documents (the first by a hash of doc_id; 200,000 unless given) fit the model.
That is the only bound: all their units with two toxic votes are in it, so it is bounded by that sample and
can be broadcast. Near copies among them share one vote. Every document is scored over its whole text.

Defined results: null and wordless texts have no passages and the lowest score; rows that repeat a
doc_id are scored each; a null doc_id is scored and not held out; labels that are null or differ for one doc_id
are left out; without labels of both kinds all scores are 0; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import _words
from gleaner.llm._labels import TRAIN_ROWS, held_out, training_rows

PRIOR = 8.0
SHIFT = 1.0
MOST = 6.0
STEMS = (5, 4)
#: A unit needs this many votes of toxic documents to be in the model.
LEAST_VOTES = 2.0
#: Bound of lambda, which has no root where clean tokens never score above zero.
MOST_RATE = 8.0
#: The least slope of the curve: evidence always ranks, even where the fold for the curve shows none.
LEAST_SLOPE = 0.05
#: Cells of the histogram of token scores.
CELLS = 97


@dataclass
class _Tokens:
    """Unit hashes of the tokens of some documents: the word, its stems (0: none)."""

    word: np.ndarray
    stems: list[np.ndarray]
    owner: np.ndarray
    count: np.ndarray


def _tokens(texts: pa.Array) -> _Tokens:
    raw, starts, ends, first = _words.split(pc.utf8_lower(texts.fill_null("")), blank=_words.NOT_ALNUM)
    word = _words.hashes(raw, starts, ends)
    lead = np.r_[np.flatnonzero((raw & 0xC0) != 0x80), len(raw)]  # where characters begin
    before = np.searchsorted(lead, starts)
    length = np.searchsorted(lead, ends) - before
    stems = []
    for n in STEMS:
        longer = length > n
        h = np.zeros(len(word), np.uint64)
        stop = lead[np.minimum(before[longer] + n, len(lead) - 1)]
        h[longer] = _words.mixed(_words.hashes(raw, starts[longer], stop) ^ np.uint64(n))
        stems.append(h)
    count = np.diff(first)
    return _Tokens(word, stems, np.repeat(np.arange(len(count)), count), count)


def _toxic_votes(batches):
    """Votes of toxic documents for each unit, by fold, with the unit that it falls back on."""
    for batch in batches:
        weight, fold = (batch[c].to_numpy(zero_copy_only=False) for c in ("weight", "fold"))
        for a, b in _words.slices(batch["text"]):
            t = _tokens(batch["text"].slice(a, b - a))
            parent = np.zeros(len(t.word), np.uint64)
            for h in reversed(t.stems):
                parent = np.where(h != 0, h, parent)
            levels = [(t.word, parent)] + [(h, t.stems[i + 1] if i + 1 < len(STEMS) else np.zeros_like(h)) for i, h in enumerate(t.stems)]
            for unit, up in levels:
                ok = unit != 0
                unit, up, owner = unit[ok], up[ok], t.owner[ok]
                if not len(unit):
                    continue
                order = np.lexsort((unit, owner))
                unit, up, owner = unit[order], up[order], owner[order]
                new = np.ones(len(unit), bool)
                new[1:] = (unit[1:] != unit[:-1]) | (owner[1:] != owner[:-1])
                unit, up, owner = unit[new], up[new], owner[new]
                keys, at, back = np.unique(unit, return_index=True, return_inverse=True)
                w, f = weight[a:b][owner], fold[a:b][owner]
                votes = [np.bincount(back, w * (f == k), len(keys)) for k in (0, 2)]
                yield pa.RecordBatch.from_pydict({"unit": keys.view(np.int64), "up": up[at].view(np.int64), "t0": votes[0], "t2": votes[1]})


def _clean_votes(units: np.ndarray):
    def run(batches):
        total = np.zeros((2, len(units)))
        for batch in batches:
            weight, fold = (batch[c].to_numpy(zero_copy_only=False) for c in ("weight", "fold"))
            for a, b in _words.slices(batch["text"]):
                t = _tokens(batch["text"].slice(a, b - a))
                for h in (t.word, *t.stems):
                    at = np.minimum(np.searchsorted(units, h), len(units) - 1)
                    ok = units[at] == h
                    pair = np.unique(t.owner[ok] * len(units) + at[ok])
                    owner, at = pair // len(units), pair % len(units)
                    for k in (0, 1):
                        total[k] += np.bincount(at, weight[a:b][owner] * (fold[a:b][owner] == 2 * k), len(units))
        hit = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_pydict({"unit": units[hit].view(np.int64), "c0": total[0][hit], "c2": total[1][hit]})
        _words.tidy()

    return run


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (from, to, score), in order, in linear time: each candidate keeps the place of
    the last one before it whose sum before is smaller, so a search never walks a link twice."""
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    sums = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    breaks = np.flatnonzero(np.diff(positive) > 1)
    begin, end = positive[np.r_[0, breaks + 1]], positive[np.r_[breaks, len(positive) - 1]] + 1
    start: list[int] = []
    stop: list[int] = []
    low: list[float] = []  # the sum before a candidate
    high: list[float] = []  # the sum at its end
    lower: list[int] = []  # the last candidate before it with a smaller sum before
    for a, b, before, after in zip(begin.tolist(), end.tolist(), sums[begin].tolist(), sums[end].tolist(), strict=True):
        j = len(low) - 1
        while True:
            while j >= 0 and low[j] >= before:
                j = lower[j]
            if j < 0 or high[j] >= after:
                break
            a, before = start[j], low[j]
            j, size = lower[j], j
            for kept in (start, stop, low, high, lower):
                del kept[size:]
        for kept, value in ((start, a), (stop, b), (low, before), (high, after), (lower, j)):
            kept.append(value)
    return [(f, t, e - s) for f, t, s, e in zip(start, stop, low, high, strict=True)]


@dataclass
class Model:
    units: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    rate: float = 1.0
    chance: float = 1.0
    slope: float = 0.0
    start: float = -50.0

    def token_scores(self, t: _Tokens) -> np.ndarray:
        """The score of the longest unit known; tokens of no known unit drift down."""
        out = np.full(len(t.word), -SHIFT, np.float32)
        if len(self.units):
            for h in (*reversed(t.stems), t.word):
                at = np.minimum(np.searchsorted(self.units, h), len(self.units) - 1)
                out = np.where(self.units[at] == h, self.scores[at], out)
        return out

    def passages(self, scores: np.ndarray) -> list[tuple[int, int, float]]:
        """Segments above chance with their excess."""
        if not len(scores):
            return []
        least = np.log(max(self.chance * len(scores), 1e-300))
        found = [(a, b, self.rate * s - least) for a, b, s in maximal_segments(scores)]
        return [x for x in found if x[2] > 0]

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.start + self.slope * evidence, -50, 50)))


def _unit_scores(units, up, toxic, clean, balance) -> np.ndarray:
    """Log-odds with the prior centred on the unit fallen back on, shifted and bounded."""
    share = np.full(len(units), 0.5)
    at = np.minimum(np.searchsorted(units, up), max(len(units) - 1, 0))
    known = (up != 0) & (units[at] == up)
    for _ in range(len(STEMS) + 1):  # one round for each level, from the shortest units down
        prior = np.where(known, share[at], 0.5)
        share = (toxic + PRIOR * prior) / (toxic + clean * balance + PRIOR)
    return np.clip(np.log(share / (1 - share)) - SHIFT, -MOST, MOST).astype(np.float32)


def _scores_of(model: Model, kind: str):
    """Per document: tokens and its best segment's score, and once a partition a histogram of token scores (kind
    'law'), or its evidence (kind 'evidence')."""

    def run(batches):
        cells = np.zeros(CELLS, np.int64)
        for batch in batches:
            for a, b in _words.slices(batch["text"]):
                t = _tokens(batch["text"].slice(a, b - a))
                s = model.token_scores(t)
                parts = np.split(s, np.cumsum(t.count)[:-1])
                columns = {c: batch[c].slice(a, b - a) for c in batch.schema.names if c != "text"}
                if kind == "law":
                    best = [max((x[2] for x in maximal_segments(p)), default=0.0) for p in parts]
                    cells += np.bincount(np.clip(np.searchsorted(np.linspace(-MOST, MOST, CELLS), s), 0, CELLS - 1), minlength=CELLS)
                    columns = {"n": pa.array(t.count, pa.int64()), "best": pa.array(best, pa.float64()), "histogram": pa.nulls(b - a, pa.list_(pa.int64()))}
                else:
                    found = [model.passages(p) for p in parts]
                    evidence = np.array([sum(x[2] for x in f) for f in found], float)
                    columns["evidence"] = pa.array(evidence)
                    columns["score"] = pa.array(model.probability(evidence))
                    columns["passages"] = pa.array([[{"from_word": x, "to_word": y, "excess": z} for x, y, z in f] for f in found], pa.list_(pa.struct([("from_word", pa.int64()), ("to_word", pa.int64()), ("excess", pa.float64())])))
                yield pa.RecordBatch.from_pydict(columns)
        if kind == "law":
            yield pa.RecordBatch.from_pydict({"n": pa.nulls(1, pa.int64()), "best": pa.nulls(1, pa.float64()), "histogram": pa.array([cells], pa.list_(pa.int64()))})
            _words.tidy()

    return run


def _law(model: Model, clean: DataFrame) -> None:
    """Fits lambda and K of ``model`` to clean documents."""
    rows = clean.select("text").mapInArrow(_scores_of(model, "law"), "n long, best double, histogram array<long>")
    rows = rows.where("n > 0 OR n IS NULL").toArrow()  # two numbers a document of the sample
    counts = np.sum([h for h in rows["histogram"].to_pylist() if h], axis=0)
    rows = rows.filter(pc.is_valid(rows["n"]))
    if not len(rows):
        return
    p, s = counts / counts.sum(), np.clip(np.linspace(-MOST, MOST, CELLS) - MOST / (CELLS - 1), -MOST, MOST)
    low, high = 1e-6, MOST_RATE  # no clean token scores above zero: the sum stays below 1 at any lambda
    if (p[s > 0] > 0).any():
        high = 1.0
        while (p * np.exp(high * s)).sum() < 1 and high < 64:
            high *= 2
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (mid, high) if (p * np.exp(mid * s)).sum() < 1 else (low, mid)
    model.rate = min(high, MOST_RATE)
    n, best = rows["n"].to_numpy(), rows["best"].to_numpy()
    model.chance = float(len(n) / (n * np.exp(-model.rate * best)).sum())


def _logistic(model: Model, evidence: np.ndarray, label: np.ndarray) -> None:
    """Slope and start by Newton's method, with targets pulled in a little (Platt), so that one kind of label will do."""
    n1, n0 = label.sum(), (1 - label).sum()
    y = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.column_stack([np.ones(len(y)), np.minimum(evidence, 60.0)])
    beta = np.array([np.log((n1 + 1) / (n0 + 1)), 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = x.T @ (x * np.maximum(p * (1 - p), 1e-9)[:, None]) + np.diag([1e-4, 1e-3])
        step = np.linalg.solve(hessian, x.T @ (y - p) - np.array([0, 1e-3 * beta[1]]))
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    model.start, model.slope = float(beta[0]), float(max(beta[1], LEAST_SLOPE))


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", *, most_rows: int = TRAIN_ROWS) -> Model:
    """A model of ``label`` from at most ``most_rows`` rows of ``labels`` that aren't held out."""
    rows = training_rows(docs, labels, label, most_rows)
    votes = rows.where("label = 1").select("text", "fold", "weight").mapInArrow(_words.tidied(_toxic_votes), "unit long, up long, t0 double, t2 double")
    votes = votes.groupBy("unit").agg(F.min("up").alias("up"), F.sum("t0").alias("t0"), F.sum("t2").alias("t2"))
    votes = votes.where(F.col("t0") + F.col("t2") >= LEAST_VOTES).toArrow()
    sums = {(r["label"], r["fold"]): r["w"] for r in rows.groupBy("label", "fold").agg(F.sum("weight").alias("w")).collect()}
    if not len(votes) or not any(k[0] == 0 for k in sums):
        return Model()
    units = votes["unit"].to_numpy().view(np.uint64)
    order = np.argsort(units)
    units, up = units[order], votes["up"].to_numpy().view(np.uint64)[order]
    toxic = np.stack([votes["t0"].to_numpy()[order], votes["t2"].to_numpy()[order]])
    clean = np.zeros_like(toxic)
    found = rows.where("label = 0").select("text", "fold", "weight").mapInArrow(_clean_votes(units), "unit long, c0 double, c2 double").groupBy("unit").agg(F.sum("c0").alias("c0"), F.sum("c2").alias("c2")).toArrow()
    at = np.searchsorted(units, found["unit"].to_numpy().view(np.uint64))
    clean[0, at], clean[1, at] = found["c0"].to_numpy(), found["c2"].to_numpy()

    def fit(folds: list[int], least: float) -> Model:
        keep = toxic[folds].sum(0) >= least
        n1, n0 = (max(1e-9, sum(sums.get((k, 2 * f), 0.0) for f in folds)) for k in (1, 0))
        scores = _unit_scores(units[keep], up[keep], toxic[folds].sum(0)[keep], clean[folds].sum(0)[keep], n1 / n0)
        return Model(units[keep], scores)

    # The law and the curve come from documents whose words the units haven't seen.
    half = fit([0], 1.0)
    other = rows.where("fold = 2")
    _law(half, other.where("label = 0"))
    seen = other.select("label", "text").mapInArrow(_words.tidied(_scores_of(half, "evidence")), "label int, evidence double, score double, passages array<struct<from_word:long,to_word:long,excess:double>>").select("label", "evidence").toArrow()
    _logistic(half, seen["evidence"].to_numpy(), seen["label"].to_numpy())
    whole = fit([0, 1], LEAST_VOTES)
    whole.rate, whole.chance, whole.slope, whole.start = half.rate, half.chance, half.slope, half.start
    return whole


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: doc_id, score, evidence, passages (token ranges with their excess)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(_words.tidied(_scores_of(model, "evidence")), "doc_id long, evidence double, score double, passages array<struct<from_word:long,to_word:long,excess:double>>")


def toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, most_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, passages."""
    out = score(docs, learn(docs, labels, most_rows=most_rows))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "passages")


def drop_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, most_rows: int = TRAIN_ROWS) -> DataFrame:
    """``docs`` without those that score ``threshold`` or more. Texts are scored where they lie."""
    model, columns = learn(docs, labels, most_rows=most_rows), docs.columns

    def run(batches):
        scored = _scores_of(model, "evidence")
        for batch in batches:
            text = batch.schema.get_field_index("text")
            bare = pa.RecordBatch.from_arrays([batch.column(text)], ["text"])
            values = np.concatenate([p["score"].to_numpy() for p in scored([bare])]) if len(batch) else np.zeros(0)
            yield batch.filter(pa.array(values < threshold))

    return docs.select(*columns).mapInArrow(_words.tidied(run), docs.schema)
