import hashlib
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.llm import _common, _words, exact_dedup, near_dedup, substring_dedup, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def as_rows(df):
    return [tuple(r) for r in df.collect()]


def test_words_are_those_of_the_pattern(rows):
    texts = [r[1] for r in rows]
    raw, starts, ends, first = _words.split(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        mine = [bytes(raw[a:b]).decode() for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]], strict=True)]
        assert mine == WORD.findall(t or "")
    h = _words.hashes(raw, starts, ends)
    names = [bytes(raw[a:b]) for a, b in zip(starts, ends, strict=True)]
    assert len({*zip(h.tolist(), names, strict=True)}) == len(set(names)) == len(set(h.tolist()))
    g = _words.grams(h, 3)
    assert len(set(g.tolist())) == len({tuple(h[i : i + 3]) for i in range(len(h) - 2)})


def test_exact_duplicates(docs, rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    out = exact_dedup.exact_duplicates(docs).collect()
    assert len(out) == len(rows)
    kept = Counter(r["text_sha256"] for r in out if r["kept"])
    sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    assert kept == Counter(dict.fromkeys(sha, 1))
    for r in out:
        ids = sha[r["text_sha256"]]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == max((i for i in ids if i is not None), default=None)


def test_ranges_change_nothing(docs, rows):
    """With a filter too small for the table, ranges of digests have one each."""
    assert exact_dedup._ranges(len(rows), 1 << 8)[0] > 2
    a = sorted(as_rows(exact_dedup.exact_duplicates(docs, max_filter_bits=1 << 8)), key=str)
    assert a == sorted(as_rows(exact_dedup.exact_duplicates(docs)), key=str)
    kept = [sorted(map(str, as_rows(exact_dedup.drop_exact_duplicates(docs, max_filter_bits=b)))) for b in (1 << 8, 1 << 27)]
    assert len(kept[0]) == len(kept[1]) and {k.split(",")[0] for k in kept[0]} == {k.split(",")[0] for k in kept[1]}


def test_repeat_filter_sets_exactly_the_cells_hit_twice(spark):
    rows = spark.createDataFrame([(bytes([i % 50]) * 4,) for i in range(70)], "digest binary").repartition(3)
    bits = 1 << 12
    hits = Counter(c for r in rows.select(*exact_dedup._cells("digest", bits)).collect() for c in r)
    got = {64 * r["word"] + b for r in exact_dedup.repeat_filter(rows, "digest", bits).collect() for b in range(64) if r["bits"] >> b & 1}
    assert got == {c for c, n in hits.items() if n > 1}


def test_drop_exact_duplicates(docs, rows, empty):
    out = exact_dedup.drop_exact_duplicates(docs)
    assert out.columns == docs.columns
    texts = Counter(r["text"] or "" for r in out.collect())
    assert texts == Counter({r[1] or "": 1 for r in rows})
    assert exact_dedup.drop_exact_duplicates(empty).count() == 0 and exact_dedup.exact_duplicates(empty).count() == 0


def near_brute(rows, k, percent=80):
    sets, by_id = {}, {}
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for i, t in rows:
        w = WORD.findall((t or "").translate(lower))
        s = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
        sets.setdefault(i, []).append(s)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [i for i in sets if i is not None]
    for x in ids:
        for y in ids:
            if x < y and any(a and b and 100 * len(a & b) >= percent * len(a | b) for a in sets[x] for b in sets[y]):
                a, b = find(x), find(y)
                parent[max(a, b)] = min(a, b)
    by_id = {i: find(i) for i in ids}
    return sets, by_id


@pytest.mark.parametrize("shingle", [2, 5])
def test_near_duplicates(docs, rows, shingle):
    sets, component = near_brute([(r[0], r[1]) for r in rows], shingle)
    out = near_dedup.near_duplicates(docs, shingle=shingle, block_shingles=700, most_members=3).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r["n_shingles"] in {len(s) for s in sets[r["doc_id"]]}
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == component[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])


def test_near_links_through_a_chain(spark):
    """Links that miss the smallest member of a key are found in the second round."""
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(base[:k] + [f"x{k}_{i}" for i in range(0)] + [f"y{i}" for i in range(k, 100)]) for k in range(100, 40, -5)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    _, component = near_brute(rows, 2)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(df, shingle=2).collect()}
    assert got == component


def test_near_ids_with_several_texts(spark):
    """One doc_id with two texts has the links of both, and ties them together."""
    a, b = ([f"{x}{i}" for i in range(100)] for x in "ab")
    text = lambda w, n: " ".join([*w[:-n], *[f"z{n}"] * n] if n else w)
    rows = [(1, text(a, 0)), (1, text(b, 0)), (2, text(a, 3)), (3, text(b, 4)), (4, text(b, 5)), (4, None), (5, None), (6, text(a, 2)), (6, "x y z")]
    for order in (rows, rows[::-1]):
        got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(order, "doc_id long, text string"), shingle=2, most_members=2).collect()}
        assert {k[0]: v for k, v in got.items()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 1} and got[4, 0] == 1


def test_near_templates_emit_no_pairs(spark, monkeypatch):
    """Two thousand unlinked documents with one template, and some linked ones among them."""
    rng = np.random.default_rng(8)
    template = [f"t{i}" for i in range(100)]
    rows = [(i, " ".join(template + [f"w{x}" for x in rng.integers(0, 1 << 30, 25)])) for i in range(2_000)]
    rows += [(3_000 + i, rows[i][1].rsplit(" ", 3)[0] + " other words here") for i in range(40)]
    seen = []
    whole = near_dedup._confirmed
    monkeypatch.setattr(near_dedup, "_confirmed", lambda pairs, *more: seen.append(pairs.distinct().count()) or whole(pairs, *more))
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), shingle=2).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == {i: i - 3_000 if i >= 3_000 else i for i, _ in rows}
    assert seen[1] < 2 * len(rows)


@pytest.mark.parametrize("percent", [80, 90])
def test_prefixes_meet(percent):
    """Any two sets that overlap enough share a shingle of their prefixes for each other's size."""
    rng = np.random.default_rng(percent)
    for _ in range(3_000):
        n = int(rng.integers(1, 120))
        x = rng.permutation(10_000)[:n]
        y = np.r_[x[rng.random(n) > rng.random() * 0.2], 10_000 + np.arange(int(rng.integers(0, n // 6 + 1)))]
        both = len(np.intersect1d(x, y))
        if 100 * both >= percent * (len(x) + len(y) - both):
            mine, other = ({(t, low, high) for low, high, k in near_dedup.prefixes(len(s), percent) for t in np.sort(s)[:k].tolist()} for s in (x, y))
            assert mine & other


def test_near_stages_write_few_files(spark, docs):
    """Small staged tables have one file, not one a task."""
    before = set(_common.staged(spark))
    near_dedup.near_duplicates(docs.repartition(8))
    files = {p.rsplit("/", 1)[1].split("-")[0]: len(list(Path(p.removeprefix("file://")).glob("*.parquet"))) for p in _common.staged(spark) if p not in before}
    assert {"sketches", "classes", "shared", "pairs", "confirmed", "open"} <= set(files)
    assert {k: n for k, n in files.items() if n > 1} == {}


def test_heaps_are_collected_by_tasks(spark):
    def collections():
        return sum(b.getCollectionCount() for b in spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans())

    before = collections()
    _common.shrink_heaps(spark)
    assert collections() > before


def test_workers_give_memory_back_after_each_batch(docs, monkeypatch):
    made = []
    kind, original = type(docs), type(docs).mapInArrow
    with monkeypatch.context() as m:
        m.setattr(kind, "mapInArrow", lambda self, f, *a, **k: made.append(f) or original(self, f, *a, **k))
        near_dedup.near_duplicates(docs)
        toxicity.score(docs, toxicity.Model())
    calls = []
    monkeypatch.setattr(_words, "tidy", lambda: calls.append(1))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["a b c", None]})
    for f in (made[0], made[-1]):  # sketches, scores
        assert sum(len(b) for b in f(iter([batch, batch]))) == 4
    assert len(calls) == 4


def test_near_empty_and_drop(docs, empty):
    assert near_dedup.near_duplicates(empty).count() == 0
    out = near_dedup.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    ids = {r["doc_id"] for r in out.collect()}
    assert 0 in ids and 30 not in ids and 33 not in ids and 3 in ids


def substring_brute(rows, window):
    seen, out = set(), Counter()
    tie = {t: int.from_bytes(hashlib.blake2b((t or "").encode(), digest_size=4).digest(), "little", signed=True) for _, t in rows}
    order = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0, tie[r[1] or ""] if r[1] in tie else tie[None]))
    result = {}
    for i, t in order:
        w = WORD.findall(t)
        cover = [False] * len(w)
        for j in range(len(w) - window + 1):
            g = tuple(w[j : j + window])
            if g in seen:
                cover[j : j + window] = [True] * window
            seen.add(g)
        result[i, t] = (len(w), sum(cover), hashlib.sha256(" ".join(x for x, c in zip(w, cover, strict=True) if not c).encode()).hexdigest())
    for i, t in rows:
        out[(i, *result[i, t or ""])] += 1
    return out


@pytest.mark.parametrize("batches, bucket", [(1, 4 << 20), (2, 1 << 14), (7, 1 << 13)])
def test_substring_dedup(docs, rows, batches, bucket, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", bucket)
    expected = substring_brute([(r[0], r[1]) for r in rows], 20)
    got = Counter(as_rows(substring_dedup.remove_repeats(docs, batches=batches, digest_only=True).select("doc_id", "n_words", "n_removed", "kept_sha256")))
    assert got == expected


def test_substring_index_goes_on(spark, clean):
    index = substring_dedup.FingerprintIndex(spark, 3, 2)
    first = substring_dedup.remove_repeats(clean.where("doc_id < 20"), batches=1, index=index)
    second = substring_dedup.remove_repeats(clean.where("doc_id >= 20"), batches=1, index=index)
    got = {r["doc_id"]: r["n_removed"] for r in first.unionByName(second).collect()}
    whole = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(clean).collect()}
    assert got == whole and sum(whole.values()) > 100
    again = substring_dedup.FingerprintIndex.open(spark, index.path)
    assert again.runs == index.runs and len(again.runs) == 2 and again.buckets == 3
    again.compact()
    assert len(again.runs) == 1 == len(substring_dedup.FingerprintIndex.open(spark, index.path).runs)
    third = substring_dedup.remove_repeats(clean.where("doc_id >= 20").withColumn("doc_id", F.col("doc_id") + 1_000), batches=1, index=again).collect()
    assert all(r["n_removed"] == r["n_words"] for r in third if r["n_words"] >= 20)


def test_substring_runs_are_compacted_on_the_way(spark, clean, monkeypatch):
    seen = []
    publish = substring_dedup.FingerprintIndex._publish
    monkeypatch.setattr(substring_dedup.FingerprintIndex, "_publish", lambda self, runs: seen.append(len(runs)) or publish(self, runs))
    assert substring_dedup.remove_repeats(clean).count() > 0 and seen == [1, 2, 1, 2, 0]
    index = substring_dedup.FingerprintIndex(spark, 3, 2, max_runs=1)
    for low in range(0, 60, 10):
        substring_dedup.remove_repeats(clean.where(f"doc_id >= {low} AND doc_id < {low + 10}"), batches=1, index=index).count()
    kept = [substring_dedup._entries(r["block"])[0] for r in index._read(index.runs).collect()]
    assert len(index.runs) == 1 and len(kept) == 3 and all((np.diff(k) > 0).all() for k in kept)


def test_several_checks_of_one_hash():
    """Hashes that agree in 64 bits are told apart by their checks, in runs and in a task's memory."""
    kh, kc = np.array([1, 5, 5, 5, 9], np.uint64), np.array([1, 3, 1, 2, 0], np.uint32)
    h, check = np.array([5, 5, 5, 5, 1, 2, 9], np.uint64), np.array([2, 1, 3, 4, 1, 1, 0], np.uint32)
    assert substring_dedup._found(kh, kc, h, check).tolist() == [3, 2, 1, -1, 0, -1, 4]


def test_repeats_between_slices_of_a_task(spark, monkeypatch):
    """Documents in falling order of id in one task, so later slices hold earlier windows."""
    monkeypatch.setattr(substring_dedup, "SLICE_BYTES", 600)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, f"{passage} a{i} {passage} b{i}" if i % 2 else f"c{i} {passage}") for i in range(60)]
    df = spark.createDataFrame(rows[::-1], "doc_id long, text string").coalesce(1)
    assert Counter(as_rows(substring_dedup.remove_repeats(df, digest_only=True))) == substring_brute(rows, 20)


def test_substring_empty(empty):
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_signature_keys_meet_within_the_distance():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 16, near_dedup.VALUES).astype(np.uint16)
    reach = near_dedup.CHUNKS * (near_dedup.ERRORS + 1) - 1
    other = base.copy()
    other[rng.choice(near_dedup.VALUES, reach, replace=False)] ^= 1
    batch = pa.RecordBatch.from_pydict({"id": pa.array([1, 2]), "signature": pa.array([base.tobytes(), other.tobytes()], pa.binary())})
    keys = defaultdict(set)
    for out in near_dedup._keys([batch]):
        for k, i in zip(out["key"].to_pylist(), out["id"].to_pylist(), strict=True):
            keys[i].add(k)
    assert keys[1] & keys[2]
