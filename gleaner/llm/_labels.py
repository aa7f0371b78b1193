"""Labelled documents for fitting models: a bounded sample, two folds, one vote for near copies.

Defined results: null labels and labels of null ids are left out, as are those of a doc_id with different labels;
labels without a document don't matter; a doc_id of several rows gives each its label.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm import _words
from gleaner.llm._common import parts_for, stage

#: The most labelled documents that a model is fitted to; the first by a hash of doc_id.
TRAIN_ROWS = 200_000
#: Rows of the sample in one task.
TASK_ROWS = 4_000
#: Documents are taken for near copies where the smallest five-word shingles by this many hashes agree.
AGREE = 3


def fold_of(doc_id: Column) -> Column:
    """The remainder that decides: 1 is held out, 0 and 2 are the two folds for learning."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % 3).cast("int")


def held_out(doc_id: Column) -> Column:
    """Whether a row never teaches. Rows without doc_id have no label to hold out: false."""
    return F.coalesce(fold_of(doc_id) == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int = TRAIN_ROWS) -> DataFrame:
    """Staged: doc_id, text, label, fold, weight of at most ``most`` labelled documents that fit a model. Documents
    that agree in their smallest five-word shingles - copies and most near copies - share a weight of 1."""
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("_other")).where("label = _other").drop("_other")
    chosen = chosen.withColumn("fold", fold_of(F.col("doc_id"))).where("fold <> 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", docs["text"].cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    def keyed(batches):
        for batch in batches:
            keys = np.zeros(len(batch), np.int64)
            for a, b in _words.slices(batch["text"]):
                raw, starts, ends, first = _words.split(batch["text"].slice(a, b - a), lower=True)
                words = _words.hashes(raw, starts, ends)
                for i in range(b - a):
                    mine = words[first[i] : first[i + 1]]
                    runs = _words.grams(mine, min(5, len(mine))) if len(mine) else mine
                    for k in range(AGREE if len(runs) else 0):
                        keys[a + i] = _words.mixed(keys[a + i : a + i + 1].view(np.uint64) + _words.mixed(runs + np.uint64(k)).min())[0].view(np.int64)
            yield batch.append_column("key", pa.array(keys))

    # As few tasks as the sample needs, whatever the number of files of all documents.
    rows = rows.repartition(parts_for(most, TASK_ROWS), F.xxhash64("doc_id")).mapInArrow(_words.tidied(keyed), "doc_id long, text string, label int, fold int, key long")
    rows = stage(rows, "labelled", reclaim=True)
    votes = rows.groupBy("key", "label").agg(F.count("*").alias("_n"))  # at most as many as rows
    return rows.join(F.broadcast(votes), ["key", "label"]).withColumn("weight", 1.0 / F.col("_n")).drop("key", "_n")
