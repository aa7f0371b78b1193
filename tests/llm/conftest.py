import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, row string, kept string, component_id double"


def words(rng, n):
    return [rng.choice("alpha beta gamma delta omega sigma kappa iota zeta theta lambda mu nu xi rho tau phi chi psi eta".split()) + str(rng.randint(0, 400)) for _ in range(n)]


def documents():
    """Every case at once: copies, near copies, shared passages, nulls, blanks, a long text, repeated rows,
    and extra columns whose names the operators use inside."""
    rng = random.Random(4)
    texts = [" ".join(words(rng, rng.randint(30, 120))) for _ in range(30)]
    passage = " ".join(words(rng, 60))
    near = texts[3].split()
    rows = [*texts, texts[0], texts[0], texts[1], " ".join(near[:-1] + ["changed"]), " ".join(["changed"] + near[1:]), f"{texts[5]} {passage}", f"{passage}\n{texts[6]}", f"start {passage} end"]
    rows += [None, "", " \t\n", "one", "One", "two words", "two  words", "été 中文 \U0001f600 x", " ".join(words(rng, 12_000))]
    out = [(i, t) for i, t in enumerate(rows)]
    out += [(5, texts[5]), (5, texts[5]), (6, "another text with a known id"), (None, "no id at all"), (None, None)]
    sources = ["a", "b", "c", "hot", "hot", "hot", None, "é"]
    return [(i, t, "en", sources[k % len(sources)], len(t or ""), k, "r", "k", 0.5) for k, (i, t) in enumerate(out)]


@pytest.fixture(scope="session")
def rows():
    return documents()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def clean(docs):
    """Rows with distinct ids only."""
    from pyspark.sql import functions as F

    once = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n = 1 AND doc_id IS NOT NULL").select("doc_id")
    return docs.join(once, "doc_id").select(*docs.columns)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
