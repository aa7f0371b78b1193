"""Registered searches read the texts once, for their own tokens, and answer as the whole index does."""

import random

import pytest
from corpus import Evaluator, rows
from pyspark.sql import functions as F

from gleaner import registry
from gleaner.operators import index as ix
from gleaner.operators import search as sx
from gleaner.sources import tables

SCHEMA = "doc_id long, url string, title string, body string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents and pages of few words, some empty, and queries over them."""
    path = str(tmp_path_factory.mktemp("focused"))
    rng = random.Random(3)
    words = "ntea estion os ndtion worthless eriner thanea re ertion other words the here".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))).replace(" other", "\n", 1) for _ in range(60)] + [""]
    spark.createDataFrame([(i, t, "en", "web") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    html = [f"<html><title>{(t or '')[:20]}</title><p>{t}</p></html>" for t in texts]
    spark.createDataFrame(list(enumerate(["u"] * len(html))), "page_id long, url string").join(spark.createDataFrame(list(enumerate(html)), "page_id long, html string"), "page_id").write.parquet(f"{path}/pages.parquet")
    queries = [(i, " ".join(rng.sample(words, 4))) for i in range(9)] + [(9, None), (10, "unknown"), (1, "ntea ntea")]
    spark.createDataFrame(queries, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("name", [*registry.SEARCHES, "pages_title_search", "batch_bm25_top10_per_query", "plain_bm25_term", "hit_total", "top10_enriched", "synonym_or_query", "synonym_not_query", "dictionary_df_cf", "documents_by_id"])
def test_a_single_query_writes_no_sorted_index(spark, folder, name, monkeypatch):
    def refused(*_):
        raise AssertionError("all postings sorted for one query")

    monkeypatch.setattr(ix, "save", refused)
    duckdb = pytest.importorskip("duckdb").connect()
    for table in ("documents", "pages", "benchmark"):
        duckdb.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    want = duckdb.execute(registry.oracle_sql()[name]).fetchall()
    assert sorted(map(tuple, registry.queries()[name](spark, folder).collect())) == sorted(want)
    registry.forget(spark)


def test_a_stored_index_of_the_session_is_used(spark, folder):
    stored = registry.index_of(spark, folder)
    assert registry.index_for(spark, folder, ["ntea"]) is stored and registry.whole(spark, folder) is stored
    registry.forget(spark)
    assert registry.index_for(spark, folder, ["ntea"]).rows is not None
    registry.forget(spark)


def test_focused_has_statistics_of_all_and_postings_of_its_tokens(spark, folder, tmp_path):
    docs = tables.from_documents(spark.read.parquet(f"{folder}/documents.parquet"))
    whole, some = ix.build(docs), ix.focused(docs, ["ntea", "os", "unknown"], str(tmp_path / "some"))
    assert some.stats == whole.stats and some.document_frequency(["os", "unknown"]) == whole.document_frequency(["os", "unknown"])
    known = whole.postings.where(F.col("token").isin("ntea", "os")).select(*some.postings.columns)
    assert sorted(map(tuple, some.postings.collect())) == sorted(map(tuple, known.collect()))
    assert ix.focused(docs, [], str(tmp_path / "none")).stats == whole.stats


@pytest.mark.parametrize("cells", [1, 40, 1 << 20])
def test_a_batch_sends_on_the_best_of_each_task(spark, cells, monkeypatch):
    """Few scores at a time and in all; ties by doc_id; negative weights count as in a single search."""
    monkeypatch.setattr(sx, "BATCH_CELLS", cells)
    docs = rows()
    queries = ["termterm or searchengine", *[" ".join(t.split()[:3]) for *_, t in docs[:25]], ""]
    index = ix.build(spark.createDataFrame(docs, SCHEMA).repartition(3))
    best = sx.batch_top(index, spark.createDataFrame(list(enumerate(queries)), "query_id long, text string"), k=3)
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan.split("Aggregate")[0]  # tasks keep their best before the window; pairs aren't aggregated
    found = {}
    for r in sorted(best.collect(), key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["doc_id"], round(r["score"], 6)))
    evaluator = Evaluator(docs)
    for i, q in enumerate(queries):
        words = dict.fromkeys(w for w in q.split() if w != "or")
        hits = evaluator.search(" or ".join(words)) if words else {}
        want = sorted(((d, round(s, 6)) for d, (_, s) in hits.items()), key=lambda x: (-x[1], x[0]))[:3]
        assert found.get(i, []) == want
