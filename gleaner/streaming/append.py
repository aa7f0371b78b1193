"""Growing an index from a stream of document files.

Each micro-batch of new documents becomes a folder of postings, lengths and documents, overwritten if the
batch runs again after a failure. Ids must be new, as for any index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from gleaner.operators import index as ix
from gleaner.sources import tsv


def append(docs: DataFrame, path: str, batch_id: int) -> None:
    """Adds (doc_id, url, title, body) to the index in ``path`` as one batch."""
    docs = docs.persist()
    built = ix.build(docs)
    tables = {ix.POSTINGS: built.postings.sortWithinPartitions("token", "doc_id"), ix.LENGTHS: built.doc_lengths, ix.DOCUMENTS: docs}
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
    docs.unpersist()


def load(spark: SparkSession, path: str) -> ix.Index:
    """The grown index; its dictionary is counted from the postings when used."""
    documents, postings, lengths = (spark.read.parquet(f"{path}/{t}").drop("batch") for t in (ix.DOCUMENTS, ix.POSTINGS, ix.LENGTHS))
    return ix.Index(documents, postings, ix.dictionary_of(postings), lengths)


def follow(spark: SparkSession, source: str, path: str, checkpoint: str, *, files_per_batch: int = 16) -> StreamingQuery:
    """Indexes tab-separated files as they arrive in ``source``, until none is left."""
    lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_batch).text(source)
    docs = tsv.parse_records(lines.where(F.col("value") != ""))
    return docs.writeStream.foreachBatch(lambda batch, i: append(batch, path, i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
