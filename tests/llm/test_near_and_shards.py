"""Near-duplicates against brute force, sharding's laws, components."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillspark.llm import common, label_propagation, minhash_join
from tests.llm.conftest import got


def brute(rows, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def changed(words, n):
    words = list(words)
    for _ in range(n):
        words[random.randrange(len(words))] = f"z{random.random()}"
    return words


@pytest.fixture(scope="module")
def family():
    random.seed(2)
    base = [f"w{k}" for k in range(150)]
    rows = [(k, " ".join(changed(base, random.randint(0, 6)))) for k in range(0, 240, 2)]
    chain = [f"c{k}" for k in range(120)]
    for k in range(60):
        chain = changed(chain, 2)
        rows.append((1000 - k, " ".join(chain)))
    rows += [(2000 + k, " ".join(f"o{k}.{j}" for j in range(random.randint(1, 60)))) for k in range(60)]
    return rows + [(3001, None), (3002, ""), (3003, " \n"), (3004, "A b"), (3005, "a B"), (3006, "a b c d e"), (3007, "A b c d E"), (3008, rows[0][1].upper())]


@pytest.mark.parametrize("percent", [80, 85])
def test_components(docs, family, percent, monkeypatch):
    monkeypatch.setattr(minhash_join, "BLOCK_LEAST", 16)
    monkeypatch.setattr(minhash_join, "BUCKET_BLOCK", 20)
    out = minhash_join.near_components(docs(family), percent=percent)
    assert got(out, "doc_id", "n_shingles", "component_id", "kept") == brute(family, percent)


def test_parts_of_clusters_meet(docs, monkeypatch):
    """Candidates that aren't links hold several parts together; links between parts are found though the candidate forest has none of them."""
    monkeypatch.setattr(minhash_join, "BLOCK_LEAST", 4)
    monkeypatch.setattr(minhash_join, "MISS", 1e-12)
    monkeypatch.setattr(minhash_join, "distance", lambda percent, miss=0: 60)
    random.seed(4)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(150):  # a drift of versions: neighbours are alike, far ones only candidates
        base = [f"v{k}x{j}" if random.random() < 0.012 else w for j, w in enumerate(base)]
        rows.append((k * 7 % 150, " ".join(base)))
    out = minhash_join.near_components(docs(rows), percent=85)
    assert got(out, "doc_id", "n_shingles", "component_id", "kept") == brute(rows, 85)


def test_similar():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 30, rng.integers(1, 30)).astype(np.uint64)) for _ in range(2))
        both, union = len(set(a.tolist()) & set(b.tolist())), len(set(a.tolist()) | set(b.tolist()))
        assert all(minhash_join.similar(a, b, p) == (100 * both >= p * union) for p in (1, 50, 80, 100))


def test_dedup_keeps_clean_documents(docs, family):
    kept = {r.doc_id for r in minhash_join.deduplicate(docs(family)).collect()}
    assert kept == {i for i, (_, _, k) in brute(family, 80).items() if k}


def test_odd_rows(docs):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "x " * 50_000)]
    out = minhash_join.near_components(docs(rows))
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in out.collect()) == [(0, 0, True), (0, 0, True), (1, 1, True), (1, 1, True), (2, 2, True)]
    assert minhash_join.near_components(docs([])).count() == 0


@pytest.mark.parametrize("t", [0, 5, 23, 24, 33, 40])
def test_masks_miss_no_pair_within_the_distance(t):
    rng = np.random.default_rng(t)
    one = rng.integers(0, 1 << 16, (300, minhash_join.HASHES), np.uint16)
    other = one.copy()
    for row in other:
        row[rng.choice(minhash_join.HASHES, t, replace=False)] += 1
    met = np.zeros(300, bool)
    for a, b in zip(minhash_join.keys(one, t), minhash_join.keys(other, t), strict=True):
        met |= a == b
    assert met.all()


def test_connected_components(spark):
    random.seed(1)
    edges = [(k, k + 1) for k in range(0, 400)] + [(1000, 1000), (2000, 2001), (2001, 2002), (2002, 2000)] + [(3000, k) for k in range(3001, 3100)]
    random.shuffle(edges)
    out = got(common.components(spark.createDataFrame(edges, "a long, b long"), "a", "b"), "node", "root")
    assert {r for (r,) in out.values()} == {0, 2000, 3000} and len(out) == 401 + 3 + 100
    assert common.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards(docs, law):
    random.seed(6)
    rows = [(k, f"group {k % 40}" if k < 120 else "hot" if k < 700 else f"own {k} " + "x" * random.randint(0, 20)) for k in range(1500)] + [(1600, None), (1601, ""), (None, "z")]
    out = label_propagation.shard(docs(rows), law=law, shards=8).collect()
    assert len(out) == len(rows)
    count, size, slots, groups = Counter(), Counter(), defaultdict(list), defaultdict(set)
    text = dict(rows)
    for r in out:
        assert r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode())
        assert r.law == law and r.size == len((text[r.doc_id] or "").encode()) + 8 and r.grown_shard is None
        count[r.shard] += 1
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        groups[text[r.doc_id]].add(r.shard)
    assert set(count) == set(range(8)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(count.values()) - min(count.values()) <= 1 if law == "rows" else max(size.values()) - min(size.values()) <= 60
    # Of 40 groups of three few are cut; of the group that is larger than a shard as many as fit are with its hub.
    hot = Counter(r.shard for r in out if text[r.doc_id] == "hot")
    assert sum(len(groups[f"group {k}"]) > 1 for k in range(40)) <= 8 and max(hot.values()) >= 0.7 * len(rows) / 8


def test_labels_are_shards(docs):
    """Few rows leave their label's shard, and propagation cuts far fewer links than the labels it begins with."""
    random.seed(9)
    rows = [(k, f"group {k % 200}" if k < 800 else f"own {k}") for k in range(2000)] + [(5000, "é" * 200_000), (5001, None), (5001, None)]
    df = docs(rows)
    out = label_propagation.shard(df)
    assert out.where("shard = label").count() >= 0.93 * len(rows)
    links = label_propagation.equal_text_edges(df.selectExpr("doc_id as id", "sha2(text, 256) as sha")).where("a < 5000")
    cut, every = label_propagation.cut_edges(out, links)
    without, _ = label_propagation.cut_edges(label_propagation.shard(df, rounds=0), links)
    assert every == 600 and cut < 0.3 * without


def test_equal_rows_are_parted(docs):
    """Rows that are the same in all of the order still get numbers of their own."""
    out = label_propagation.shard(docs([(7, "same")] * 500 + [(None, "none")] * 300), shards=3).collect()
    assert sorted((r.shard, r.slot) for r in out) == [(k, j) for k, n in ((0, 267), (1, 267), (2, 266)) for j in range(n)]


def test_no_documents(docs):
    assert label_propagation.shard(docs([])).count() == 0
    assert sorted(r.slot for r in label_propagation.shard(docs([(1, "a"), (1, "a")])).collect()) == [0, 0]


def test_linked_by_edges(docs, spark):
    """Rings of documents end up mostly whole: far fewer edges are cut than by chance."""
    edges = [(r * 10 + k, r * 10 + (k + d) % 10) for r in range(60) for k in range(10) for d in (1, 2, 3)]
    out = got(label_propagation.shard(docs([(k, f"t{k}") for k in range(600)]), edges=spark.createDataFrame(edges, "a long, b long"), shards=4, rounds=10), "doc_id", "shard")
    cut = sum(out[a] != out[b] for a, b in edges)
    assert cut < 0.45 * len(edges)
