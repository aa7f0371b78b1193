"""Dense-vector search: exact dot products over all vectors, and the embedding job.

An encoder is a callable from a text to a vector (queries) or a picklable callable from a list of texts to
a list of vectors (documents); none is shipped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import vectors as vx
from gleaner.sources.tsv import document_text

DEFAULT_K = 10
DEFAULT_DIM = 64


def prepared(vector: Column, dim: int = DEFAULT_DIM) -> Column:
    """Layer norm over all of the vector, its first ``dim`` numbers, unit length."""
    return vx.l2_normalize(vx.truncate(vx.layer_norm(vector), dim))


def prepared_query(vector: Sequence[float], dim: int = DEFAULT_DIM) -> list[float]:
    """``prepared`` for the one vector of a query, on the driver."""
    v = np.asarray(vector, np.float64)
    v = ((v - v.mean()) / np.sqrt(v.var() + vx.EPSILON))[:dim]
    norm = np.linalg.norm(v)
    return (v / norm if norm > 0 else v).tolist()


def mean_pooled(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Average of token states where the mask is set; an empty mask gives zeros."""
    weight = mask[..., None].astype(np.float64)
    return (states * weight).sum(axis=1) / np.maximum(weight.sum(axis=1), 1e-9)


def search(vectors: DataFrame, query: Sequence[float], k: int = DEFAULT_K, *, id_column: str = "doc_id", vector_column: str = "embedding") -> DataFrame:
    """(doc_id, score) of the ``k`` best dot products, smaller ids first on ties; k <= 0 means ten."""
    k = k if k > 0 else DEFAULT_K
    scored = vectors.select(F.col(id_column).alias("doc_id"), vx.dot(F.col(vector_column), vx.literal(query)).alias("score"))
    return scored.orderBy(F.desc(F.round("score", 6)), "doc_id").limit(k)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Stored vectors; a missing table is an empty one."""
    from gleaner.operators.index import _exists

    if not _exists(spark, path):
        return spark.createDataFrame([], "doc_id long, embedding array<float>")
    return spark.read.parquet(path)


def embed(docs: DataFrame, encoder: Callable[[list[str]], Sequence[Sequence[float]]], *, dim: int = DEFAULT_DIM, batch: int = 64) -> DataFrame:
    """(doc_id, embedding) for (doc_id, title, body), encoded in batches on the executors."""
    rows = docs.select("doc_id", document_text(F.concat_ws(" ", "title", "body")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in batches:
            for i in range(0, len(found), batch):
                part = found.slice(i, batch)
                made = [[float(x) for x in v] for v in encoder(part["text"].to_pylist())]
                yield pa.RecordBatch.from_arrays([part["doc_id"].cast(pa.int64()), pa.array(made, pa.list_(pa.float64()))], ["doc_id", "raw"])

    raw = rows.mapInArrow(run, "doc_id long, raw array<double>")
    return raw.select("doc_id", prepared(F.col("raw"), dim).cast("array<float>").alias("embedding"))


def save_vectors(vectors: DataFrame, path: str) -> None:
    """Writes (doc_id, embedding), for ``load_vectors``."""
    vectors.write.mode("overwrite").parquet(path)
