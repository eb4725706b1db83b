import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from loomspark.llm import spelling
from loomspark.llm.spelling import Filters, spelling_variants

ALPHABET = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))


def lower(s):
    return "".join(c.lower() if c.isascii() else c for c in s)


def near(w):
    out = {w[:i] + w[i + 1 :] for i in range(len(w))}
    out |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in ALPHABET}
    out |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in ALPHABET}
    return out - {w}


def brute(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    form, found = {}, {}
    for w, n in counts.items():
        found[w] = [v for v in near(w) if v in counts]
        best = min(found[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 5 * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(found[w]), form[w] and counts[form[w]]) for w, n in counts.items()}


def corpus(seed):
    rng = random.Random(seed)
    bases = ["".join(rng.choices("abcdeéÉüß", k=rng.randint(5, 11))) for _ in range(40)] + ["aabbaabb", "Straßen", "xxxxxxx", "÷×ÿÀàab"]
    words = {}
    for b in bases:
        words[b] = rng.choice([3, 20, 200, 900])
        for _ in range(6):
            w = rng.choice(sorted(words)) if rng.random() < 0.4 else b
            i = rng.randrange(len(w))
            edited = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abcé") + w[i + 1 :], w[:i] + rng.choice("abé") + w[i:]])
            words.setdefault(edited, rng.choice([4, 5, 6, 30, 150]))
    flat = [w.upper() if rng.random() < 0.1 and w.isascii() else w for w, n in words.items() for _ in range(n)]
    rng.shuffle(flat)
    return [(i, rng.choice([" ", "\n", "1", "_"]).join(flat[a : a + 120])) for i, a in enumerate(range(0, len(flat), 120))]


@pytest.mark.parametrize("most_blocks", [1 << 19, 6])
def test_rows_equal_brute_force(spark, monkeypatch, most_blocks):
    monkeypatch.setattr(spelling, "PIECE", 64)
    monkeypatch.setattr(spelling, "HELD", 50)
    monkeypatch.setattr(spelling, "AT_ONCE", 4000)
    rows = corpus(most_blocks)
    got = [tuple(r) for r in spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"), most_blocks).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)
    assert any(r[1] for r in got) and any(r[1] and r[2] != r[1] for r in got)


def test_filters_know_all_words_and_few_others():
    rng = random.Random(7)
    words = sorted({"".join(rng.choices("abcdefghij", k=rng.randint(6, 9))) for _ in range(5000)})
    sizes = Counter(map(len, words))
    f = Filters("abcdefghij", sizes)
    at, lanes = f.entries(words)
    f.lanes = np.zeros((f.total, 8), np.uint32)
    np.bitwise_or.at(f.lanes, at, lanes)
    edits = [(words[i], e) for i, e in f.edits(words)]
    known = set(words)
    true = {(w, v) for w in words for v in near(w) if v in known and (len(v) < len(w) or (len(v) == len(w) and v > w))}
    assert true <= set(edits)
    probes = sum(len(w) + len(w) * 4.5 for w in words)
    assert len(edits) - len(true) < 0.01 * probes
    assert len(edits) == len(set(edits))


def test_long_words(spark):
    a = "ab" * 3000
    rows = [(i, f"{a} {a} {a[:2000]}x{a[2001:]} {a[:-1]}") for i in range(9)]
    got = {r["word"]: r for r in spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # The spoilt runs make no further words here; near words of a: one replaced, one deleted.
    assert got[a]["n_near"] == 2 and got[a]["form"] is None


def test_odd_rows(spark, odd_docs):
    got = {tuple(r) for r in spelling_variants(odd_docs).collect()}
    assert got == brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert spelling_variants(odd_docs.limit(0)).collect() == []
    assert spelling_variants(odd_docs.filter("text IS NULL")).collect() == []
