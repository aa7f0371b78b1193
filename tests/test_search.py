import random

import numpy as np
import pytest
from corpus import Evaluator, rows
from pyspark.sql import functions as F

from gleaner.functions import vectors as vx
from gleaner.operators import index as ix
from gleaner.operators import search as sx
from gleaner.operators import semantic, synonyms, workload
from gleaner.plans.nodes import QueryError
from gleaner.sources import tables, tsv
from gleaner.streaming import append

SCHEMA = "doc_id long, url string, title string, body string"


@pytest.fixture(scope="module")
def index(spark):
    return ix.build(spark.createDataFrame(rows(), SCHEMA), check_ids=True).persist()


def found(index, query, k=None):
    return [(r["doc_id"], round(r["score"], 6)) for r in sx.ranked(sx.hits(index, query), k).collect()]


@pytest.mark.parametrize(
    "query, expected",
    [
        ("ranksearch rankengine", [(1001, 4.20937), (1003, 4.20937), (1002, 4.131894)]),
        ("notcat and not notdog", [(4002, 2.065947)]),
        ("orcat and ordog or orbird", [(5001, 4.894259), (5002, 3.053108), (5003, 2.44713)]),
        ("(parencat or parendog) and parenbird", [(6001, 5.070842), (6002, 5.070842)]),
        ('"phrasequick phrasebrown"', [(7003, 4.4409), (7001, 3.447615)]),
        ("title", [(3000 + i, 0.63316) for i in range(11)]),
        ("alpha", [(1001, 2.696033), (2001, 2.696033), (4001, 2.696033)]),
        ('"beta rankengine"', [(1002, 5.259419)]),
        ("ordog ordog", [(5004, 6.106215), (5001, 4.894259)]),
        ("missingtokenxyz", []),
        ("limitterm", [(3000 + i, 0.662876) for i in range(11)]),
    ],
)
def test_golden_scores(index, query, expected):
    assert found(index, query) == expected


def test_totals_frequencies_and_top(index):
    response = sx.search(index, "limitterm")
    assert response.bm25.count() == 10 and response.total == 11
    ttf = {r["doc_id"]: r["total_term_frequency"] for r in sx.hits(index, "ranksearch rankengine").collect()}
    assert ttf == {1001: 3, 1003: 3, 1002: 2}
    matches = {r["doc_id"]: r["matches"] for r in sx.hits(index, '"phrasequick phrasebrown"').collect()}
    assert [(m["token"], m["frequency"]) for m in matches[7003]] == [("phrasequick", 2), ("phrasebrown", 2)]
    assert list(matches[7003][1]["positions"]) == [1, 3]


@pytest.mark.parametrize("query, message", [("", "query must not be empty"), ("not negcat", "query must contain at least one positive term"), ("notcat or not notdog", "NOT expressions")])
def test_errors(index, query, message):
    with pytest.raises(QueryError, match=message):
        sx.search(index, query)


def test_stats(index):
    assert index.stats.documents == 29
    assert index.stats.avg_title == pytest.approx(26 / 29) and index.stats.avg_body == pytest.approx(61 / 29)
    assert index.dictionary.count() == 26
    assert index.document_frequency(["limitterm", "nothing"]) == {"limitterm": 11, "nothing": 0}


def test_random_queries_against_plain_evaluation(spark, index):
    docs = rows()
    plain = Evaluator(docs)
    for query in workload.generate([f"{t} {b}" for _, _, t, b in docs], 12):
        expected = {d: (f, round(s, 6)) for d, (f, s) in plain.search(query).items()}
        got = {r["doc_id"]: (r["total_term_frequency"], round(r["score"], 6)) for r in sx.hits(index, query).collect()}
        assert got == expected, query


def test_pruning_from_a_thousand_documents(spark):
    rng = random.Random(1)
    docs = [(i, "", "common" if i % 2 else "", " ".join(rng.choices(["rare"] * (i % 50 == 0) + [f"w{j}" for j in range(40)], k=12))) for i in range(1000)]
    index, plain = ix.build(spark.createDataFrame(docs, SCHEMA)).persist(), Evaluator(docs)
    assert sx.search(index, "common").total == 0
    with pytest.raises(QueryError):
        sx.search(index, "common and not rare")
    for query in ("common rare", '"common w1"', "w1 or rare", "rare and not w3"):
        got = {r["doc_id"]: round(r["score"], 6) for r in sx.hits(index, query).collect()}
        assert got == {d: round(s, 6) for d, (_, s) in plain.search(query, pruning=True).items()}
    index.unpersist()


def test_enrich_render_json(spark, index):
    top = sx.ranked(sx.hits(index, "ranksearch"))
    full = sx.enrich(top, index.documents.where("doc_id <> 1002"))
    assert [r["doc_id"] for r in full.collect()] == [1003, 1001]
    assert "ranksearch count: 2" in sx.rendered(full).first()["line"]
    answer = sx.as_json(index, "ranksearch")
    assert answer["total"] == 3 and answer["bm25_results"][0]["id"] == "1003" and answer["semantic_results"] is None
    assert sx.as_json(index, "missingtokenxyz")["bm25_results"] is None


def test_synonyms(spark, index):
    table = spark.createDataFrame([("orcat", "OrBird", 1), ("orcat", "ordog", 2), ("orcat", "notcat", 3)], "term string, synonym string, rank int")
    provider = synonyms.from_table(table, ["orcat"])
    assert {r["doc_id"] for r in sx.hits(index, "orcat", provider).collect()} == {5001, 5002, 5003, 5004}
    assert {r["doc_id"] for r in sx.hits(index, "(orbird or ordog or orcat) and not orcat", synonyms.from_mapping({"orcat": ["negcat"]})).collect()} == {5002, 5004}


def test_save_load_and_build_if_missing(spark, tmp_path):
    lines = ["1\turl1\talpha\tbeta", "2\turl2\tbeta\talpha beta", "3\turl3\tgamma\tbeta gamma", "short\tline", "4\tu\tt\tx\ty"]
    (tmp_path / "docs.tsv").write_text("\n".join(lines) + "\n")
    out = str(tmp_path / "index")
    index = ix.ensure_index(spark, str(tmp_path / "docs.tsv"), out)
    assert ix.manifest(spark, out)["documentCount"] == 4
    assert index.document_frequency(["alpha", "beta", "x"]) == {"alpha": 2, "beta": 3, "x": 1}
    again = ix.ensure_index(spark, "/nowhere", out)
    assert {r["doc_id"] for r in sx.hits(again, "beta").collect()} == {1, 2, 3}
    plan = again.postings.where(F.col("token").isin("alpha"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(token" in plan or "EqualTo(token" in plan
    with pytest.raises(ValueError):
        ix.build_index(spark, "", out)


def test_tsv(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('123\tu\tFirst\tText with\textra\n9\tx\n456\tu2\t"q\tsecond\n')
    docs = tsv.load(spark, str(tmp_path / "a.tsv")).orderBy("doc_id").collect()
    assert [(d["doc_id"], d["title"], d["body"]) for d in docs] == [(123, "First", "Text with\textra"), (456, '"q', "second")]
    assert tsv.load(spark, str(tmp_path / "a.tsv"), 1).count() == 1
    with pytest.raises(ValueError):
        tsv.load(spark, "x", -1)
    (tmp_path / "b.tsv").write_text("D1\tu\tt\tb\n")
    with pytest.raises(Exception, match="invalid document id"):
        tsv.load(spark, str(tmp_path / "b.tsv")).collect()
    fixed = tsv.parse_records(tsv.strip_id_prefix(tsv.lines(spark, str(tmp_path / "b.tsv"))))
    assert fixed.first()["doc_id"] == 1
    (tmp_path / "q.txt").write_text("one\r\n\n  two \n")
    assert tsv.load_queries(spark, str(tmp_path / "q.txt")) == ["one", "two"]


def test_repeated_ids_and_tokenless_documents(spark):
    with pytest.raises(ValueError, match="unique"):
        ix.build(spark.createDataFrame([(1, "", "a", "b"), (1, "", "c", "d")], SCHEMA), check_ids=True)
    index = ix.build(spark.createDataFrame([(1, "", "", "the"), (2, "", "", "cat")], SCHEMA))
    assert index.stats.documents == 2 and index.stats.avg_title == 0
    assert found(index, "cat")[0][0] == 2
    empty = ix.build(spark.createDataFrame([], SCHEMA))
    assert (empty.stats.documents, empty.stats.avg_body) == (0, 0.0)


def test_adapters(spark):
    docs = spark.createDataFrame([(1, "Head\nrest\nmore", "s"), (2, "alone", "s"), (3, None, None)], "doc_id long, text string, source string")
    assert [(r["title"], r["body"]) for r in tables.from_documents(docs).orderBy("doc_id").collect()] == [("Head", "rest\nmore"), ("", "alone"), ("", "")]
    page = spark.createDataFrame([(1, "u", "<html><title>Hi</title><p>a<b>c</b></p></html>")], "page_id long, url string, html string")
    row = tables.from_pages(page).first()
    assert row["title"] == "Hi" and row["body"].split() == ["a", "c"]


def test_vectors(spark):
    rows_ = [(i, [float(i == j) + 0.01 * i for j in range(4)]) for i in range(5)]
    df = spark.createDataFrame(rows_, "doc_id long, embedding array<float>")
    best = semantic.search(df, [1.0, 0.0, 0.0, 0.0], 2).collect()
    assert [r["doc_id"] for r in best] == [0, 4]
    assert semantic.search(df, [1.0, 0, 0, 0], 0).count() == 5
    made = df.select(vx.layer_norm(F.col("embedding")).alias("v"), vx.l2_normalize(F.array(F.lit(0.0))).alias("z"), semantic.prepared(F.col("embedding"), 2).alias("p")).first()
    assert sum(made["v"]) == pytest.approx(0, abs=1e-9) and made["z"] == [0.0] and sum(x * x for x in made["p"]) == pytest.approx(1)
    docs = spark.createDataFrame([(7, "a", "bb"), (8, "", "c")], "doc_id long, title string, body string")
    out = semantic.embed(docs, lambda texts: [[float(len(t)), 1.0, 2.0] for t in texts], dim=2)
    assert {r["doc_id"]: len(r["embedding"]) for r in out.collect()} == {7: 2, 8: 2}
    assert semantic.load_vectors(spark, "/nowhere/vectors").count() == 0


def test_semantic_errors_leave_the_lexical_answer(spark, index):
    def broken(_):
        raise RuntimeError

    response = sx.search(index, "limitterm", vectors=index.documents, encoder=broken)
    assert response.total == 11 and response.semantic is None


def test_semantic_errors_of_the_run_leave_the_lexical_answer(spark, index):
    """A vector that can't be read shows only when the job runs."""
    vectors = spark.createDataFrame([(1001, [1.0] * 4)], "doc_id long, embedding array<float>").withColumn("embedding", F.when(F.col("doc_id") < 0, F.col("embedding")).otherwise(F.raise_error(F.lit("broken")).cast("array<float>")))
    response = sx.search(index, "limitterm", vectors=vectors, encoder=lambda q: [1.0, 2.0, 3.0, 4.0])
    assert response.total == 11 and response.semantic is None
    answer = sx.as_json(index, "limitterm", vectors=vectors, encoder=lambda q: [1.0, 2.0, 3.0, 4.0])
    assert answer["total"] == 11 and answer["semantic_results"] is None and len(answer["bm25_results"]) == 10


def test_the_query_vector_is_prepared_as_documents_are(spark, index):
    asked = []

    def encoder(text):
        asked.append(text)
        return [3.0, 1.0, 2.0, 9.0]

    raw = spark.createDataFrame([(1001, [3.0, 1.0, 2.0, 9.0]), (1002, [9.0, 1.0, 2.0, 3.0])], "doc_id long, embedding array<double>")
    vectors = raw.select("doc_id", semantic.prepared(F.col("embedding"), 2).alias("embedding"))
    best = sx.search(index, "limitterm", vectors=vectors, encoder=encoder, dim=2).semantic.collect()
    assert asked == ["search_query: limitterm"] and best[0]["doc_id"] == 1001 and best[0]["score"] == pytest.approx(1)
    assert semantic.prepared_query([3.0, 1.0, 2.0, 9.0], 2) == pytest.approx(list(vectors.where("doc_id = 1001").first()["embedding"]))
    assert semantic.prepared_query([2.0, 2.0]) == [0.0, 0.0]
    states = np.arange(12, dtype=float).reshape(2, 3, 2)
    assert semantic.mean_pooled(states, np.array([[1, 1, 0], [0, 0, 0]])).tolist() == [[1.0, 2.0], [0.0, 0.0]]


def test_a_build_without_documents_leaves_nothing(spark, tmp_path):
    (tmp_path / "none.tsv").write_text("short\tline\n")
    (tmp_path / "docs.tsv").write_text("1\tu\talpha\tbeta\n")
    out = str(tmp_path / "index")
    for _ in range(2):
        with pytest.raises(ValueError, match="no documents indexed"):
            ix.ensure_index(spark, str(tmp_path / "none.tsv"), out)
    assert ix.ensure_index(spark, str(tmp_path / "docs.tsv"), out).stats.documents == 1
    with pytest.raises(ValueError, match="no documents indexed"):
        ix.build_index(spark, str(tmp_path / "none.tsv"), out)
    assert ix.load(spark, out).stats.documents == 1 and [p.name for p in tmp_path.iterdir() if ".new-" in p.name] == []


def test_lookups_and_hits_are_pushed_down(spark, tmp_path):
    ix.save(ix.build(spark.createDataFrame(rows(), SCHEMA)), str(tmp_path / "index"))
    index = ix.load(spark, str(tmp_path / "index"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "In(doc_id" in plan(sx.enrich(sx.search(index, "limitterm").bm25, index.documents))
    assert "In(token" in plan(sx.hits(index, "notcat and not notdog"))
    assert sorted(r["doc_id"] for r in ix.lookup(index, [1001, 77, 1002]).collect()) == [1001, 1002]
    semantic.save_vectors(spark.createDataFrame([(1, [1.0])], "doc_id long, embedding array<float>"), str(tmp_path / "v"))
    assert semantic.load_vectors(spark, str(tmp_path / "v")).count() == 1


def test_workload():
    docs = ["alpha beta gamma delta epsilon", "one two three four five six", "tiny"]
    assert workload.generate(docs, 30) == workload.generate(docs, 30) and len(workload.generate(docs, 30)) == 30
    with pytest.raises(ValueError):
        workload.generate(docs, 0)
    with pytest.raises(ValueError):
        workload.generate(["x"], 1)


def test_streaming_growth(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "index")
    source.mkdir()
    (source / "a.tsv").write_text("1\tu\talpha\tbeta\n2\tu\tgamma\tbeta\n")
    append.follow(spark, str(source), path, str(tmp_path / "check")).awaitTermination()
    (source / "b.tsv").write_text("3\tu\talpha\tdelta\n")
    append.follow(spark, str(source), path, str(tmp_path / "check")).awaitTermination()
    grown = append.load(spark, path)
    assert grown.stats.documents == 3 and grown.document_frequency(["alpha", "beta"]) == {"alpha": 2, "beta": 2}
    assert {r["doc_id"] for r in sx.hits(grown, "alpha").collect()} == {1, 3}
