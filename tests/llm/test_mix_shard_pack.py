import hashlib
import re
import zlib
from collections import Counter, defaultdict
from importlib.util import find_spec
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.llm import fingerprints, mixing, packing, queries, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sizes(text):
    return len(WORD.findall(text or ""))


def fill(source_sizes, weights=(1, 2, 3), repeats=3.0):
    """Targets by the written rule, round by round."""
    names = sorted(source_sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(source_sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > repeats * source_sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: repeats * source_sizes[s] for s in over}


@pytest.mark.parametrize("block", [7, 256])
def test_mix(docs, rows, block):
    out = mixing.taken_words(docs, block_words=block, shard_words=500)
    got = out.collect()
    assert len(got) == len(rows)
    by_source = defaultdict(int)
    for r in rows:
        by_source[r[3]] += sizes(r[1])
    target = fill(by_source)
    assert Counter((r["doc_id"], r["size"], r["source_size"]) for r in got) == Counter((r[0], sizes(r[1]), by_source[r[3]]) for r in rows)
    taken, targets = defaultdict(int), {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source_size"]] += r["taken"]
        targets[r["source_size"]] = r["target"]
    for s, n in by_source.items():
        assert targets[n] == pytest.approx(target[s])
        assert abs(taken[n] - target[s]) <= 0.5 + 1e-6
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, got), key=str)


def test_mixed_documents_hold_the_words_taken(docs, rows):
    out = mixing.mixed_documents(docs, block_words=16)
    assert out.columns == docs.columns
    words = Counter()
    for r in out.collect():
        words[r["source"]] += sizes(r["text"])
        assert r["n_chars"] == len(r["text"] or "")
    by_source = defaultdict(int)
    for r in rows:
        by_source[r[3]] += sizes(r[1])
    for s, t in fill(by_source).items():
        assert abs(words[s] - t) <= 0.5 + 1e-6


def test_mix_empty(empty):
    assert mixing.taken_words(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutation(spark, n):
    p = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(9).cast("long")).alias("p")).collect()
    assert sorted(r["p"] for r in p) == list(range(n))


def test_shards_hold_the_counts_drawn(spark, docs):
    """A multinomial draw by source, and as many slots in each shard of the mix."""
    want = spark.createDataFrame([(1, 4_000), (2, 40_000), (3, 0)], "rank int, slots long")
    draws = mixing.drawn_counts(want, 20, 44_000, 5).collect()
    for rank, slots in ((1, 4_000), (2, 40_000)):
        mine = sorted((r["shard"], r["blocks"], r["first"]) for r in draws if r["rank"] == rank)
        assert [m[2] for m in mine] == [sum(x[1] for x in mine[:i]) for i in range(len(mine))] and sum(m[1] for m in mine) == slots
        chi = sum((m[1] - slots / 20) ** 2 / (slots / 20) for m in mine)
        assert 4 < chi < 45  # 19 degrees of freedom
    _, _, slots = mixing.mix(docs, block_words=16, shard_words=300)
    got = Counter((r["shard"], r["rank"]) for r in slots.select("rank", "slot", "shard").distinct().collect())
    assert len({s for s, _ in got}) > 3 and max(got.values()) < sum(got.values()) / 3


def test_difference():
    rng = np.random.default_rng(2)
    weights = [float(x) for x in rng.integers(1, 10_000, 2000)]
    for start in (None, [90_000.0, 0, 0, 0, 5, 0, 0, 0]):
        sums = list(start or [0.0] * 8)
        for w, s in zip(weights, sharding.difference(weights, 8, start), strict=True):
            sums[s] += w
        assert max(sums) - min(sums) <= 3
    assert sharding.difference([], 8) == []
    assert sorted(sharding.difference([5.0, 5.0, 5.0], 8)) == sorted(set(sharding.difference([5.0, 5.0, 5.0], 8)))


def test_sharding(docs, rows, empty):
    out = sharding.shard_by_bytes(docs, chunk_groups=9).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    shards = defaultdict(list)
    of_text = defaultdict(set)
    for r in out:
        shards[r["shard"]].append(r["slot"])
        of_text[r["text_crc32"]].add(r["shard"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in shards.values()) and set(shards) <= set(range(8))
    assert max(map(len, of_text.values())) == 1
    assert sharding.shard_by_bytes(empty).count() == 0


def test_many_empty_texts_are_a_heavy_group(spark):
    """Groups of many rows go by broadcast even where they have few bytes."""
    df = spark.createDataFrame([(i, None if i % 3 else f"text {i} " * 50) for i in range(6_000)], "doc_id long, text string")
    out = sharding.shard_by_bytes(df).collect()
    size = Counter()
    for r in out:
        size[r["shard"]] += r["size"]
    assert len(out) == 6_000 and len({r["shard"] for r in out if r["size"] == 1}) == 1 and max(size.values()) - min(size.values()) < 1_000


def test_sharding_is_even_but_for_a_huge_group(spark):
    rng = np.random.default_rng(3)
    texts = ["hot" * 100] * 700 + ["x" * int(n) for n in rng.integers(1, 900, 900)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    size = Counter()
    for r in sharding.shard_by_bytes(df).collect():
        size[r["shard"]] += r["size"]
    small = sorted(size.values())[:-1]
    assert max(small) - min(small) <= 2 and max(size.values()) == 700 * 301


def test_fingerprints(clean, empty):
    out = {r["doc_id"]: r for r in fingerprints.fingerprints(clean, bucket_rows=7).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in clean.collect()}
    ids = sorted(texts)

    def jaccard(a, b):
        a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := WORD.findall(t)) else set() for t in (a, b))
        return len(a & b) / len(a | b) if a | b else 1.0

    errors = []
    for i, j in zip(ids, ids[1:] + ids[:1], strict=True):
        cut = len(texts[i]) // 4
        edited = texts[i][: len(texts[i]) - cut] + texts[j][:cut]
        r = out[i]
        assert r["n_chars"] == len(texts[i]) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        errors += [abs(r["near_edited"] - jaccard(texts[i], edited)), abs(r["near_next"] - jaccard(texts[i], texts[j]))]
    assert max(errors) < 0.2 and sum(errors) / len(errors) < 0.03
    same = defaultdict(set)
    for i in ids:
        same[texts[i]].add(out[i]["fingerprint"])
    assert all(len(s) == 1 for s in same.values()) and out[38]["fingerprint"] == ""
    assert fingerprints.fingerprints(empty).count() == 0


def test_fingerprints_with_repeated_and_null_ids(docs, rows):
    out = fingerprints.fingerprints(docs, bucket_rows=5).collect()
    assert Counter((r["doc_id"], r["n_chars"]) for r in out) == Counter((r[0], len(r[1] or "")) for r in rows)
    one = docs.where("doc_id = 7")
    assert fingerprints.fingerprints(one).first()["near_next"] == 1.0


needs_vocabulary = pytest.mark.skipif(find_spec("public_tokenizers") is None, reason="no vocabulary file")


@needs_vocabulary
@pytest.mark.parametrize("length", [64, 2048])
def test_packing_round_trip(docs, rows, empty, length):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.TOKENIZER)
    out = packing.pack(docs, queries.TOKENIZER, length=length, range_bytes=1 << 14, block_bytes=1 << 12, cell_nodes=5).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        assert len(r["ids"]) == 4 * r["length"] > 0
        pieces[r["doc_id"], r["doc_tokens"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    want = Counter()
    for r in rows:
        want[r[0], tuple([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1])] += 1
    for (doc, ids), n in want.items():
        found = Counter()
        for p in pieces[doc, len(ids)]:
            assert p["start"] + p["length"] <= len(ids)
            if tuple(np.frombuffer(p["ids"], "<u4")) == ids[p["start"] : p["start"] + p["length"]]:
                found.update(range(p["start"], p["start"] + p["length"]))
        assert all(found[i] >= n for i in range(len(ids)))
    assert sum(r["length"] for r in out) == sum(len(ids) * n for (_, ids), n in want.items())
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= length and (at == length or at & (at - 1) == 0)
    assert packing.pack(empty, queries.TOKENIZER).count() == 0


@needs_vocabulary
def test_packing_splits_copies_beyond_a_range(spark):
    df = spark.createDataFrame([(i, "the same text " * 20) for i in range(400)], "doc_id long, text string")
    out = packing.pack(df, queries.TOKENIZER, range_bytes=1 << 14).collect()
    assert Counter(r["doc_id"] for r in out if r["start"] == 0) == Counter(range(400)) and len({r["sequence_id"] >> 32 for r in out}) > 4


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no tables")
def test_graph_recall(spark):
    """The neighbours found against brute force over all nodes, for every node."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    links, layout = packing.graph(docs, cell_nodes=25, probe=1.2)
    assert len(layout.centroids) > 30 and layout.probes < 9
    rows = links.collect()
    sketch = np.unique(packing.quantized(pa.array([r["text"] for r in docs.select("text").collect()])), axis=0)
    ids, v = packing.node_ids(sketch), packing._vectors([sketch.tobytes()])
    assert sorted(r["node"] for r in rows) == sorted(ids.tolist())
    near = v @ v.T
    np.fill_diagonal(near, -2)
    at = {int(i): k for k, i in enumerate(ids)}
    hit = 0
    for r in rows:
        bar = np.sort(near[at[r["node"]]])[-packing.NEIGHBOURS]
        found = [at[int(x)] for x in np.frombuffer(r["near"], np.int64) if x != -1]
        assert len(set(found)) == len(found) and at[r["node"]] not in found
        hit += sum(near[at[r["node"]], j] >= bar - 1e-5 for j in found)
    assert hit / (packing.NEIGHBOURS * len(rows)) > 0.85


def test_walk():
    """Paths start at the lowest degree and go to the nearest unvisited neighbour."""
    near = np.array([[1, -1], [2, 0], [1, 3], [2, -1], [-1, -1]])
    alike = np.array([[0.9, 0], [0.8, 0.9], [0.8, 0.95], [0.95, 0], [0, 0]], np.float32)
    assert packing.walk(5, near, alike) == [4, 0, 1, 2, 3] and packing.walk(0, near[:0], alike[:0]) == []


@needs_vocabulary
def test_encoder_is_the_tokenizer():
    from tokenizers import Tokenizer

    tokenizer, encoder = Tokenizer.from_file(queries.TOKENIZER), packing.Encoder(queries.TOKENIZER)
    assert encoder.fast
    rng = np.random.default_rng(6)
    letters = list("aabbeelloott'''sdmreéèüßñ!?.,$%&*|<>-_0129ÀÖ×÷²µ \n\t") + ["\x1c", " ", "é", "中", "\U0001f600", "İ", "Σ"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(2000)] + ["a" * k for k in range(40)]
    texts += ["x<|endoftext|>y <|startoftext|>", "<|ENDOFTEXT|> <|endoftext|>", "don't WE'LL it's", "a''s 'test '", "l'l 'LLama 're' 'v 'VE", "\u00a0x\x85y", "e\u0301 \u0301", None, ""]
    for part in (texts, *[[t] for t in texts[-9:]], [], texts[::-1]):
        ids, first = encoder.block(pa.array(part, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == [e.ids for e in tokenizer.encode_batch([t or "" for t in part], add_special_tokens=False)]


@needs_vocabulary
@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no tables")
def test_encoder_is_the_tokenizer_on_all_documents():
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    tokenizer, encoder = Tokenizer.from_file(queries.TOKENIZER), packing.Encoder(queries.TOKENIZER)
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].combine_chunks()
    want = [e.ids for e in tokenizer.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
    for a in range(0, len(texts), 300):
        ids, first = encoder.block(texts.slice(a, 300))
        assert [ids[x:y].tolist() for x, y in zip(first[:-1], first[1:], strict=True)] == want[a : a + 300]
