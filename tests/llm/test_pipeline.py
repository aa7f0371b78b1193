from collections import Counter
from importlib.util import find_spec
from pathlib import Path

import pytest

from gleaner.llm import _common

pytestmark = pytest.mark.skipif(find_spec("corpus_pipeline") is None or find_spec("public_tokenizers") is None, reason="no pipeline or vocabulary")


def test_stages(spark, docs, rows, tmp_path):
    import corpus_pipeline

    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now = docs
    sizes = []
    for i, (name, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"stage{i}"))
        now = spark.read.parquet(str(tmp_path / f"stage{i}"))
        if i < 4:
            assert now.columns == docs.columns, name
        sizes.append(now.count())
    assert sizes[0] == len(rows)  # nothing is toxic here
    texts = {r[1] or "" for r in rows}
    assert sizes[1] == len(texts)
    assert sizes[2] < sizes[1]
    before = set(_common.staged(spark))
    run = corpus_pipeline.run(spark, str(tmp_path))
    left = [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in _common.staged(spark) if p not in before]
    assert left == ["source_mix", "nodes", "graph"]  # what the last stage reads
    assert "ids" in run.columns
    assert run.groupBy().sum("length").first()[0] == now.groupBy().sum("length").first()[0]
    assert Counter(map(type, corpus_pipeline.STAGES)) == {tuple: 5}
    assert Path(corpus_pipeline.__file__).name == "corpus_pipeline.py"


def test_empty_documents_and_null_labels(spark, docs, empty, tmp_path):
    import corpus_pipeline

    for name, table, labels in (("none", empty, []), ("unlabelled", docs, [(1, None, None), (None, 1, 1)])):
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / name))
        assert out.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        assert (out.count() > 0) == (name != "none")
