import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from loomspark.llm import simhash
from loomspark.llm.simhash import close_fingerprints, fingerprint, near_duplicates


def plain(text, k=3):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    shingles = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(keys, fps):
    """Smallest key reachable, by brute force; keys may be None."""
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    of = {}
    for i in range(len(fps)):
        of.setdefault(root(i), []).append(keys[i])
    return [min((k for k in of[root(i)] if k is not None), default=None) for i in range(len(fps))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def clusters(seed, n=500, bits=9):
    """Fingerprints around a few centres, with chains of near ones, among others."""
    rng = random.Random(seed)
    out = set()
    for _ in range(3):
        centre, places = rng.getrandbits(64), rng.sample(range(64), bits)
        for _ in range(n // 4):
            out.add(centre ^ sum(1 << b for b in places if rng.random() < 0.5))
    while len(out) < n:
        x = rng.choice(sorted(out)) if rng.random() < 0.5 else rng.getrandbits(64)
        for b in rng.sample(range(64), rng.randint(0, 5)):
            x ^= 1 << b
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("hot,few,cells", [(8192, 32, 1 << 20), (5, 4, 50), (1, 32, 64)])
def test_edges_connect_what_is_near(spark, monkeypatch, hot, few, cells):
    monkeypatch.setattr(simhash, "FEW", few)
    monkeypatch.setattr(simhash, "CELLS", cells)
    fps = clusters(hot)
    edges = [(r["a"] & (2**64 - 1), r["b"] & (2**64 - 1)) for r in close_fingerprints(spark.createDataFrame([(signed(x),) for x in fps], "fp long"), hot).collect()]
    parent = {x: x for x in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert [root(x) for x in fps] == components(fps, fps)


def test_a_value_over_many_batches():
    """A group that spans batches, with small groups beside it, gives the components of the whole."""
    rng = random.Random(3)
    fps = np.array(clusters(11, 300), np.uint64)
    key, fp, asks = simhash.filed(fps)
    order = np.lexsort((asks, key))
    key, fp, asks = key[order].view(np.int64), fp[order].view(np.int64), asks[order]
    cuts = sorted(rng.sample(range(len(key)), 900))
    batches = [pa.RecordBatch.from_arrays([pa.array(x[a:b]) for x in (key, fp, asks)], names=["key", "fp", "asks"]) for a, b in zip([0, *cuts], [*cuts, len(key)], strict=True)]
    whole = pa.RecordBatch.from_arrays([pa.array(x) for x in (key, fp, asks)], names=["key", "fp", "asks"])

    def joined(parts):
        parent = {int(x): int(x) for x in fps.view(np.int64)}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for batch in simhash.links(iter(parts), None):
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parent[max(root(a), root(b))] = min(root(a), root(b))
        return [root(x) for x in parent]

    assert joined(batches) == joined([whole])


def test_a_dense_value_gives_a_forest():
    """No more edges than rows, though all pairs are linked."""
    fps = np.array([1 << i | 1 << j for i in range(12) for j in range(i)], np.uint64)
    group = simhash.Group(fps)
    a, b = group.own()
    assert len(a) < len(fps)


@pytest.mark.parametrize("text", [None, "", " \n\t", "one", "One two", "one two three", "a  b\tc\nd a b c d Á á", "x " * 500])
def test_fingerprint(monkeypatch, text):
    monkeypatch.setattr(simhash, "PIECE", 7)
    assert fingerprint(text) == plain(text)


def test_seed_is_the_one_of_spark(spark):
    h = spark.range(1).select(F.xxhash64(F.lit("one two three"))).first()[0]
    assert h & (2**64 - 1) == plain("one two three")


def test_documents_equal_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows, texts = [], []
    for i in range(150):
        w = rng.choices(words, k=rng.choice([0, 1, 2, 40, 400]))
        if texts and rng.random() < 0.6:
            w = list(rng.choice(texts))
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w)) : None] = w[: rng.randint(0, 3)] if rng.random() < 0.2 else w[rng.randrange(len(w)) :]
        texts.append(w or ["W"])
        rows.append((i * 7 % 151, " ".join(w)))
    fps = [plain(t) for _, t in rows]
    want = {(d, f"{f:016x}", c) for (d, _), f, c in zip(rows, fps, components([d for d, _ in rows], fps), strict=True)}
    assert {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_odd_rows(spark, odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    fps = [plain(t) for _, t in rows]
    want = sorted(map(str, ((d, f"{f:016x}", c) for (d, _), f, c in zip(rows, fps, components([d for d, _ in rows], fps), strict=True))))
    assert sorted(str(tuple(r)) for r in near_duplicates(odd_docs).collect()) == want
    assert near_duplicates(odd_docs.limit(0)).collect() == []
