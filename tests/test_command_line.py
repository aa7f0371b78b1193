import pytest
from corpus import rows

from gleaner.__main__ import arguments, generate, respond, synonym_table
from gleaner.operators import answers
from gleaner.operators import index as ix
from gleaner.sources import tsv


def test_lines_are_answered(spark):
    index = ix.build(spark.createDataFrame(rows(), "doc_id long, url string, title string, body string"))
    said = []
    respond(index, ["notcat and not notdog", "", "not negcat", ">exit", "title"], said.append)
    assert said[0].startswith("1. Beta https://corpus/4002 [notcat count: 1] length: 3 score: 2.0659")
    assert said[1].startswith("1 hits") and said[2].startswith("type a query") and "positive term" in said[3] and len(said) == 4


def test_arguments():
    args = arguments(["--indexdir", "x", "--limit", "5", "--buildindex"])
    assert (args.limit, args.buildindex, args.query) == (5, True, None)


def test_generated_queries_and_synonyms(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("".join(f"{i}\tu\talpha beta\tgamma delta epsilon word{i}\n" for i in range(9)))
    args = arguments(["--data", str(tmp_path / "c.tsv"), "--genqueries", "25", "--out", str(tmp_path / "q")])
    assert generate(spark, args) == tsv.load_queries(spark, str(tmp_path / "q"))
    with pytest.raises(SystemExit):
        arguments(["--genqueries", "3"])
    with pytest.raises(SystemExit):
        arguments([])
    (tmp_path / "s.tsv").write_text("one\ttwo\t1\n")
    index = ix.build(spark.createDataFrame([(1, "", "", "two three")], "doc_id long, url string, title string, body string"))
    said = []
    respond(index, ["one"], said.append, synonym_table(spark, str(tmp_path / "s.tsv")))
    assert said[-1].startswith("1 hits")


def test_answers():
    asked = {}

    def writer(prompt, **options):
        asked.update(options, prompt=prompt)
        return " yes \n"

    assert answers.answer("is it", writer) == "yes" and asked["max_tokens"] == 50 and "is it" in asked["prompt"]
    with pytest.raises(answers.NoWriter):
        answers.answer("x", None)
    with pytest.raises(ValueError):
        answers.answer(" ", writer)
