import random

import pytest

from loomspark.llm import jaccard_join
from loomspark.llm.jaccard_join import near_duplicates, one_of_each


def brute(rows, words, percent):
    sets = []
    for _, text in rows:
        w = "".join(c.lower() if c.isascii() else c for c in text or "").split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b, key=lambda k: rows[k][0])] = min(a, b, key=lambda k: rows[k][0])
    return {(rows[i][0], len(sets[i]), rows[root(i)][0]) for i in range(len(rows))}


def corpus(seed, n=240):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=30)
    rows, texts = [], []
    for i in range(n):
        kind = rng.random()
        if kind < 0.5 and texts:
            w = list(rng.choice(texts[:12]))
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 1)] = [rng.choice(vocabulary)]
        else:
            w = rng.choices(vocabulary, k=rng.choice([0, 1, 2, 3, 8, 20, 60, 150]))
            if kind > 0.8:
                w = passage + w[:20]
        texts.append(w or ["Word"])
        rows.append((i * 3, " ".join(w).upper() if rng.random() < 0.1 else " ".join(w)))
    return rows


@pytest.mark.parametrize("words,percent,often,block", [(3, 90, 16, 64), (5, 80, 3, 4), (2, 60, 2, 2)])
def test_components_equal_brute_force(spark, monkeypatch, words, percent, often, block):
    monkeypatch.setattr(jaccard_join, "COMMON_DOCS", often)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "HOME_BLOCK", block)
    rows = corpus(words)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words, percent).collect()
    assert {tuple(r) for r in got} == brute(rows, words, percent)


def test_large_home_with_few_outsiders(spark):
    """A thousand near copies and a few texts that share entries with them but are less alike, some alike among themselves."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:-1] + [f"x{i}"])) for i in range(1, 1200)]
    for i in range(4):
        w = base[:]
        w[20 + i] = w[35] = f"y{i}"
        rows.append((5000 + i, " ".join(w)))
        rows.append((6000 + i, " ".join([*w, "z"])))
    rng.shuffle(rows)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert {tuple(r) for r in got} == brute(rows, 3, 90)
    assert len({r.component_id for r in got}) == 5


def test_common_shingles_have_a_bit(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(jaccard_join, "COMMON_DOCS", 3)
    tokens = np.random.default_rng(1).integers(-(2**63), 2**63, 500)
    df = spark.createDataFrame([(int(t), 3 if i < 300 else 2) for i, t in enumerate(tokens)], "token long, df long")
    found = jaccard_join.is_common(tokens.view(np.uint64), jaccard_join._bitmap(df))
    assert found[:300].all() and found[300:].sum() < 60
    monkeypatch.setattr(jaccard_join, "MOST_BITS", 6)  # full: every shingle is common
    assert len(jaccard_join._bitmap(df)) == 1


def test_odd_rows(spark, odd_docs):
    got = {(r.doc_id, r.n_shingles > 0, r.component_id) for r in near_duplicates(odd_docs, 3, 90).collect()}
    assert got == {(1, False, 1), (2, False, 2), (3, False, 3), (4, True, 4), (5, True, 5), (None, True, None), (7, True, 7)}
    assert near_duplicates(odd_docs.limit(0), 3, 90).count() == 0
    kept = one_of_each(odd_docs)
    assert kept.count() == 8 and kept.columns == odd_docs.columns


def test_sketch_never_refuses_a_link():
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(1, 700))
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[: int(len(x) * rng.random())], rng.integers(0, 2**63, int(rng.integers(0, 300)), dtype=np.uint64)]))
        (a, lost_a), (b, lost_b) = jaccard_join.sketch(x), jaccard_join.sketch(y)
        bound = jaccard_join.most_shared(jaccard_join._counts(a), jaccard_join._counts(b)) + lost_a + lost_b
        assert bound >= len(np.intersect1d(x, y))
