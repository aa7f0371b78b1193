"""The positional inverted index: build, save, load.

Positions run over the title's tokens and then the body's as one sequence, after stopwords are gone. The
index is four tables: documents, postings (one row per token and document, with both field lengths so
that a query needs no join), dictionary (document and collection frequency) and doc_lengths.
"""

from __future__ import annotations

import atexit
import datetime as dt
import json
import shutil
import tempfile
import uuid
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text as tx
from gleaner.sources import tsv

POSTINGS, DICTIONARY, LENGTHS, DOCUMENTS, MANIFEST = "postings", "dictionary", "doc_lengths", "documents", "manifest.json"

#: Frequencies of tokens that an index remembers.
MOST_KNOWN = 100_000


@dataclass(frozen=True)
class Stats:
    documents: int
    avg_title: float
    avg_body: float


@dataclass
class Index:
    documents: DataFrame
    postings: DataFrame
    dictionary: DataFrame
    doc_lengths: DataFrame
    path: str = ""
    #: Of a focused index: doc_id, title_len, body_len, found (array<struct<token, positions>>), one row a document.
    rows: DataFrame | None = None
    _known: dict[str, int] = field(default_factory=dict, repr=False)

    @cached_property
    def stats(self) -> Stats:
        """One small job per index, not per query. Documents without tokens count."""
        row = self.doc_lengths.agg(F.count("*").alias("n"), *field_averages()).first()
        return Stats(row["n"], row["avg_title"], row["avg_body"])

    def document_frequency(self, tokens: list[str]) -> dict[str, int]:
        """df of each token, 0 where unknown; reads only these tokens' rows, and each token's once."""
        new = [t for t in tokens if t not in self._known]
        if new:
            if len(self._known) > MOST_KNOWN:
                self._known.clear()
                new = tokens
            found = {r["token"]: r["df"] for r in self.dictionary.where(F.col("token").isin(new)).select("token", "df").collect()}
            self._known.update((t, found.get(t, 0)) for t in new)
        return {t: self._known[t] for t in tokens}

    def grouped(self, tokens: list[str]) -> DataFrame:
        """One row per document that holds any of the tokens: doc_id, title_len, body_len, found (array<struct<token, positions>>)."""
        if self.rows is not None:
            return self.rows.where(F.size("found") > 0)
        of_tokens = self.postings.where(F.col("token").isin(tokens))
        return of_tokens.groupBy("doc_id", "title_len", "body_len").agg(F.collect_list(F.struct("token", "positions")).alias("found"))

    def persist(self) -> Index:
        """Keeps postings, dictionary and lengths in memory or on local disk."""
        for table in (self.postings, self.dictionary, self.doc_lengths):
            table.persist()
        return self

    def unpersist(self) -> None:
        for table in (self.postings, self.dictionary, self.doc_lengths):
            table.unpersist()


def field_averages() -> list:
    return [F.coalesce(F.avg("title_len"), F.lit(0.0)).alias("avg_title"), F.coalesce(F.avg("body_len"), F.lit(0.0)).alias("avg_body")]


def tokenized(docs: DataFrame) -> DataFrame:
    """(doc_id, tokens, title_len, body_len): the title's tokens before the body's."""
    both = docs.select("doc_id", tx.tokens(F.col("title")).alias("_t"), tx.tokens(F.col("body")).alias("_b"))
    return both.select("doc_id", F.concat("_t", "_b").alias("tokens"), F.size("_t").alias("title_len"), F.size("_b").alias("body_len"))


def occurrences(docs: DataFrame) -> DataFrame:
    """One row per kept token: doc_id, token, pos, title_len, body_len."""
    return tokenized(docs).select("doc_id", "title_len", "body_len", F.posexplode("tokens").alias("pos", "token"))


def _by_token(tokens: Column, only: list[str] | None = None) -> Column:
    """array<struct<token, positions>> of one document: its (token, position) pairs (of the tokens in ``only``, if
    given) sorted, then cut where the token changes. Null without pairs."""

    def let(value: Column, body) -> Column:
        return F.element_at(F.transform(F.array(value), body), 1)

    def cut(pairs: Column) -> Column:
        n = F.size(pairs)

        def changes(i: Column) -> Column:
            return (i == 0) | (F.get(pairs, i)["token"] != F.get(pairs, i - 1)["token"])

        def groups(starts: Column) -> Column:
            def group(at: Column, k: Column) -> Column:
                length = F.coalesce(F.get(starts, k + 1), n) - at
                positions = F.transform(F.slice(pairs, at + 1, length), lambda x: x["pos"])
                return F.struct(F.get(pairs, at)["token"].alias("token"), positions.alias("positions"))

            return F.transform(starts, group)

        return let(F.filter(F.sequence(F.lit(0), n - 1), changes), groups)

    if only is not None:
        pairs = F.transform(tokens, lambda t, i: F.when(t.isin(only), F.struct(t.alias("token"), i.alias("pos"))))
        return let(F.sort_array(F.filter(pairs, lambda x: x.isNotNull())), lambda found: F.when(F.size(found) > 0, cut(found)))
    pairs = F.sort_array(F.transform(tokens, lambda t, i: F.struct(t.alias("token"), i.alias("pos"))))
    return F.when(F.size(tokens) > 0, let(pairs, cut))


def postings_of(docs: DataFrame) -> DataFrame:
    """One row per (token, document), grouped within the document's own row: nothing shuffles."""
    rows = tokenized(docs).select("doc_id", "title_len", "body_len", F.explode(_by_token(F.col("tokens"))).alias("_g"))
    return rows.select(F.col("_g.token").alias("token"), "doc_id", "title_len", "body_len", F.col("_g.positions").alias("positions"))


def dictionary_of(postings: DataFrame) -> DataFrame:
    return postings.groupBy("token").agg(F.count("*").alias("df"), F.sum(F.size("positions")).cast("long").alias("cf"))


def lengths_of(docs: DataFrame) -> DataFrame:
    return tokenized(docs).select("doc_id", "title_len", "body_len")


def build(docs: DataFrame, *, check_ids: bool = False) -> Index:
    """The index of (doc_id, url, title, body). ``check_ids`` makes repeated ids an error."""
    if check_ids:
        repeated = docs.groupBy("doc_id").count().where("count > 1").limit(5).collect()
        if repeated:
            raise ValueError(f"document ids must be unique; repeated: {[r['doc_id'] for r in repeated]}")
    postings = postings_of(docs)
    return Index(docs, postings, dictionary_of(postings), lengths_of(docs))


def focused(docs: DataFrame, tokens: list[str], path: str) -> Index:
    """An index for these tokens alone: the texts are read and cut into tokens once, and a row per document, with both
    lengths and the positions of these tokens, is written to ``path``. Statistics are those of all documents and
    frequencies of these tokens are exact, so searches for them answer as with the whole index."""
    none = F.array().cast("array<struct<token:string,positions:array<int>>>")
    found = F.coalesce(_by_token(F.col("tokens"), tokens), none) if tokens else none
    tokenized(docs).select("doc_id", "title_len", "body_len", found.alias("found")).write.parquet(path)
    rows = docs.sparkSession.read.parquet(path)
    postings = rows.select("doc_id", "title_len", "body_len", F.explode("found").alias("_g"))
    postings = postings.select(F.col("_g.token").alias("token"), "doc_id", "title_len", "body_len", F.col("_g.positions").alias("positions"))
    return Index(docs, postings, dictionary_of(postings), rows.select("doc_id", "title_len", "body_len"), path, rows)


def save(index: Index, path: str, *, token_partitions: int | None = None) -> None:
    """Writes the index as Parquet. Postings and dictionary are range-partitioned and sorted by token, documents
    by doc_id, so that a filter on either skips files and row groups by their statistics.

    An index without documents is an error, and leaves nothing behind: all is written beside ``path`` and
    takes its place at the end.
    """
    spark = index.postings.sparkSession
    if index.documents.isEmpty():
        raise ValueError("no documents indexed")
    made = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    try:
        index.documents.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.parquet(f"{made}/{DOCUMENTS}")
        spread = [token_partitions] if token_partitions else []
        index.postings.repartitionByRange(*spread, "token", "doc_id").sortWithinPartitions("token", "doc_id").write.parquet(f"{made}/{POSTINGS}")
        dictionary_of(spark.read.parquet(f"{made}/{POSTINGS}")).repartitionByRange("token").sortWithinPartitions("token").write.parquet(f"{made}/{DICTIONARY}")
        index.doc_lengths.write.parquet(f"{made}/{LENGTHS}")
        counts = {"documentCount": DOCUMENTS, "tokenCount": DICTIONARY}
        manifest = {k: spark.read.parquet(f"{made}/{t}").count() for k, t in counts.items()} | {"createdAt": dt.datetime.now(dt.timezone.utc).isoformat()}
        _write_text(spark, f"{made}/{MANIFEST}", json.dumps(manifest, indent=2))
        fs, where = _fs(spark, path)
        fs.delete(where, True)
        if not fs.rename(_fs(spark, made)[1], where):
            raise OSError(f"{made} can't be renamed to {path}")
    except BaseException:
        fs, where = _fs(spark, made)
        fs.delete(where, True)
        raise


_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only a local master without that setting gets one of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="gleaner-index-")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
    return "file://" + _own_dirs[app]


def load(spark: SparkSession, path: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{t}") for t in (DOCUMENTS, POSTINGS, DICTIONARY, LENGTHS)), path=path)


def delete(spark: SparkSession, index: Index) -> None:
    """Deletes the folder of a loaded index."""
    fs, where = _fs(spark, index.path)
    fs.delete(where, True)


def manifest(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/{MANIFEST}", wholetext=True).collect()))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether an index was written there to the end: its manifest comes last."""
    return _exists(spark, f"{path}/{MANIFEST}")


def build_index(spark: SparkSession, data_path: str, out_path: str, limit: int = 0) -> Index:
    """Index a tab-separated corpus into a folder."""
    if not data_path:
        raise ValueError("data path is required")
    if not out_path:
        raise ValueError("output directory is required")
    save(build(tsv.load(spark, data_path, limit)), out_path)
    return load(spark, out_path)


def ensure_index(spark: SparkSession, data_path: str, out_path: str, limit: int = 0) -> Index:
    """The index in ``out_path``, built first if it isn't there."""
    return load(spark, out_path) if exists(spark, out_path) else build_index(spark, data_path, out_path, limit)


def lookup(index: Index, doc_ids: list[int]) -> DataFrame:
    return index.documents.where(F.col("doc_id").isin(doc_ids))


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, where = _fs(spark, path)
    out = fs.create(where, True)
    out.write(bytearray(text.encode()))
    out.close()
