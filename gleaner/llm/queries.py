"""The registered queries of this subpackage, over the tables of a scale-factor folder."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import exact_dedup, fingerprints, mixing, near_dedup, packing, quality, secrets, sharding, substring_dedup, toxicity

#: The vocabulary file of a public tokenizer; any tokenizers file will do.
TOKENIZER = str(public_tokenizers.path("word_bpe_49k.json"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts of ``documents``: one row a document, the largest doc_id of a group stays."""
    return exact_dedup.exact_duplicates(_documents(spark, sf_dir))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of ``documents`` in 20-word windows that occur earlier as well: counts, and a digest of the rest."""
    return substring_dedup.remove_repeats(_documents(spark, sf_dir), window=20, digest_only=True)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of ``documents`` and of their edited texts, with likenesses."""
    return fingerprints.fingerprints(_documents(spark, sf_dir))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate for a secret in ``documents``, with the forest's probability; the path is the source."""
    return secrets.scan(_documents(spark, sf_dir), secrets.train(spark), path="source")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as token pieces in sequences of at most 2048, related documents together."""
    return packing.pack(_documents(spark, sf_dir), TOKENIZER, length=2048, digest_only=True)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for each of ``documents``, learned from labels that aren't held out."""
    return toxicity.toxicity(_documents(spark, sf_dir), _labels(spark, sf_dir), threshold=0.7)


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each of ``documents`` the mix takes at weights 1, 2, 3, repeating."""
    return mixing.taken_words(_documents(spark, sf_dir), weights=(1, 2, 3), most_repeats=3.0)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for each of ``documents``, learned from labels that aren't held out."""
    return quality.quality(_documents(spark, sf_dir), _labels(spark, sf_dir), threshold=0.5)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of ``documents`` linked by 80 % of their two-word shingles."""
    return near_dedup.near_duplicates(_documents(spark, sf_dir), shingle=2)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` in eight shards of nearly equal bytes, equal texts together."""
    return sharding.shard_by_bytes(_documents(spark, sf_dir), shards=8)


def queries() -> dict:
    """Every query of this module by name."""
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: Words of a document, and the letters that lower-casing changes.
_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = {
    "op1_substring_dedup": f"""
        WITH w AS (SELECT doc_id, {_WORDS.format("text")} AS words FROM documents),
        p AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w),
        g AS (SELECT doc_id, i, words[i] AS word, CASE WHEN i + 19 <= len(words) THEN array_to_string(words[i:i + 19], ' ') END AS run FROM p),
        m AS (SELECT doc_id, i, word, CASE WHEN run IS NOT NULL AND row_number() OVER (PARTITION BY run ORDER BY doc_id, i) > 1 THEN i END AS marked FROM g),
        c AS (SELECT doc_id, i, word, max(marked) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM m),
        s AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS r, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
        SELECT w.doc_id, coalesce(n, 0) AS n_words, coalesce(r, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN s ON w.doc_id = s.doc_id
    """,
    "op8_near_dedup": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS words FROM documents),
        g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 1 THEN words ELSE [words[i] || ' ' || words[i + 1] FOR i IN range(1, len(words))] END) AS s FROM w WHERE len(words) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 80 * (x.n + y.n - m)),
        r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
        SELECT c.a AS doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.a = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.a
    """,
    "op10_exact_dedup": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(x) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY x)
    """,
}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL with the same rows, for those that SQL can express."""
    return dict(ORACLE)
