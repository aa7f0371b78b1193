"""A corpus pipeline: toxic documents, exact copies and near copies go, sources are mixed to their
target weights, and related documents are packed into training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of ``documents``. ``run`` writes each stage's result to the shared folder and reads
it again for the next. After mixing, a doc_id may occur in several rows, one for each time its text is
taken; packing treats them as documents of their own.

Defined results: a null text is not toxic, equals the empty text, and is packed as its end token where the mix takes
it (it has no words, so the mix leaves it out); rows with a null doc_id pass the near-copy stage; labels that are missing, null
or clashing teach nothing, and without labels of both kinds no document is toxic; an empty table gives an empty result; further
columns travel along up to packing, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from gleaner.llm._common import release, stage, staged
from gleaner.llm.queries import TOKENIZER


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go; the model learns from the labels that aren't held out."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.7)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest doc_id stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked as the contract of op8 links them (80 % of two-word shingles), the smallest doc_id stays."""
    return near_dedup.drop_near_duplicates(docs, shingle=2, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 1, 2, 3, repeating; no document more than three times."""
    return mixing.mixed_documents(docs, weights=(1, 2, 3), most_repeats=3.0)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens, with their token ids."""
    return packing.pack(docs, TOKENIZER, length=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]

#: Learned scores and token ids have no SQL twin; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = len(staged(spark))
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name, reclaim=True)
        release(spark, since=before, but_last=True)  # what this stage and the one before it staged
    return STAGES[-1][1](spark, docs, sf_dir)
