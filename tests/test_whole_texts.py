from collections import Counter
from pathlib import Path

import pytest

from gleaner import registry
from gleaner.sources import tsv

TEXTS = ["a\tb\tc", "line\nends\r\nand\rmore", "", " \t ", None, "x" * 200_000, "word\t" * 50_000, "\tstarts", "ends\t", "été\t中文 \U0001f600", "ideographic blank　", "line separator  ", "unit separator\x1f", '"quoted\t"', "plain"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("whole")
    rows = [(i, t, "en" if i % 4 else None, "web") for i, t in enumerate(TEXTS * 8)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(path / "documents.parquet"))
    return str(path)


def plain_lines(spark, d):
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        yield "\t".join([str(r["doc_id"]), r["source"] or "", r["lang"] or "", (r["text"] or "").replace("\n", " ").replace("\r", " ")])


def folders(folder):
    return [folder, *[d for d in ["/root/testdata/sf0.01"] if Path(d).exists()]]


def test_every_document_is_parsed_whole(spark, folder):
    for d in folders(folder):
        want = Counter((int(i), u, t, b) for i, u, t, b in (line.split("\t", 3) for line in plain_lines(spark, d)))
        assert Counter(map(tuple, registry.queries()["record_parse_filter"](spark, d).collect())) == want


def test_every_document_gets_its_whole_embedding_text(spark, folder):
    for d in folders(folder):
        want = Counter()
        for line in plain_lines(spark, d):
            f = line.strip().split("\t")
            want[int(f[0]), "search_document: " + (f[2] + " " + " ".join(f[3:]) if len(f) >= 4 else " ".join(f[1:]))] += 1
        assert Counter(map(tuple, registry.queries()["embedding_texts"](spark, d).collect())) == want


def test_malformed_rows(spark):
    lines = ["1\tu\tt\tb", "2\tu\tt", "3", "", "bad\tu\tt\tb", "-1\tu\tt\tb", "4294967296\tu\tt\tb", " 5\tx \t"]
    rows = spark.createDataFrame([(x,) for x in lines], "value string")
    assert [tuple(r) for r in tsv.parse_records(rows.limit(4)).collect()] == [(1, "u", "t", "b")]
    with pytest.raises(Exception, match="invalid document id"):
        tsv.parse_records(rows.where("value LIKE 'bad%'")).collect()
    assert sorted(map(tuple, tsv.embedding_texts(rows).collect())) == [(1, "search_document: t b"), (2, "search_document: u t"), (5, "search_document: x")]


def test_lines_are_stripped_as_python_strips(spark):
    """Every blank at either end and inside, letters next to them, and lines of nothing else."""
    blanks = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    assert sorted(tsv.BLANKS) == blanks
    lines = [f"{b}7\t{b}x{b}\tt{b}y\t{b}z{b}\tw{b}\t{b}" for b in blanks if b not in "\t"] + ["".join(blanks), "8\t\t\t\t\t", "\u200b9\ta\u200b", "9\ta\u200b\u3000"]
    want = []
    for line in lines:
        f = line.strip().split("\t")
        if len(f) >= 2 and f[0].strip(" ").isdigit():
            want.append((int(f[0]), "search_document: " + (f[2] + " " + " ".join(f[3:]) if len(f) >= 4 else " ".join(f[1:]))))
    rows = spark.createDataFrame([(x,) for x in lines], "value string")
    assert Counter(map(tuple, tsv.embedding_texts(rows).collect())) == Counter(want)
    plan = tsv.embedding_texts(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan  # each blank of a text cost a try of the pattern
