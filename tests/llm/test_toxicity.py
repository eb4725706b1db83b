import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from loomspark.llm.toxicity import PART, SENTENCE, Landmarks, margins, marked, sentences, toxicity, without_toxic


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("thaeonrsidl") for _ in range(rng.randint(2, 9)))
    rows, labels = [], []
    for i in range(900):
        text = [word() for _ in range(rng.randint(5, 80))]
        bad = rng.random() < 0.2
        for _ in range(rng.randint(1, 4) if bad else 0):
            w = rng.choice(["blockhead", "gobshite", "muppet", "pillock"])
            text.insert(rng.randrange(len(text)), rng.choice([w, w, w.capitalize() + ",", "-".join(w), w.replace("o", "0")]) if i > 300 else w)
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(corpus):
    docs, labels = corpus
    got = toxicity(docs, labels).join(labels, "doc_id").collect()
    assert len(got) == 900 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out]
    found = [r for r in held if r.toxic and r.predicted]
    assert len(found) >= 0.85 * sum(r.toxic for r in held) and sum(r.predicted for r in held) - len(found) <= 0.05 * len(held)


def test_odd_rows(spark, corpus, odd_docs):
    _, labels = corpus
    got = toxicity(odd_docs, labels).collect()
    assert len(got) == 8 and all(0 <= r.score <= 1 for r in got)
    nothing = spark.createDataFrame([(1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    assert {r.score for r in toxicity(odd_docs, nothing).collect()} == {0.0}
    kept = without_toxic(odd_docs, nothing)
    assert kept.count() == 8 and kept.columns == odd_docs.columns
    assert toxicity(odd_docs.limit(0), labels).count() == 0


def test_shared_stems_and_inserted_characters_in_several_languages(spark):
    """Insults are stems with endings, half of which no taught text has; some have a character put in."""
    rng = random.Random(2)
    syllables = {"a": "tha er on in ed ti ou re".split(), "b": "äch lich ung ver sch keit ö ü".split(), "c": "éa ique oi eau tre ç ê le".split()}
    stems, endings = {"a": "gobsh", "b": "trott", "c": "crét"}, ["el", "ine", "os", "ac", "uil", "ade", "ort", "imo"]
    rows, labels = [], []
    for i in range(1200):
        lang = rng.choice("abc")
        word = lambda: "".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4)))  # noqa: B023, E731
        text, bad, taught = [word() for _ in range(rng.randint(8, 90))], rng.random() < 0.2, zlib.crc32(str(i).encode()) % 4 in (0, 1)
        for _ in range(rng.randint(2, 4) if bad else 0):
            w = stems[lang] + rng.choice(endings[:4] if taught else endings)
            k = rng.randint(2, 4)
            text.insert(rng.randrange(len(text)), rng.choice([w, w, w, w[:k] + rng.choice("x*-") + w[k:]]))
        rows.append((i, " ".join(text), lang))
        labels.append((i, int(bad)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    held = [r for r in toxicity(docs, labels).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect() if r.held_out]
    for lang in "abc":
        toxic, clean = ([r.predicted for r in held if r.lang == lang and r.toxic == t] for t in (1, 0))
        assert sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.05 * len(clean)


def test_sentences_cover_all_words():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["word ", "end. ", "x", "\n", "y" * 40 + " ", "(in) ", "! ", "é ", "s t u "]) for _ in range(rng.randrange(0, 60)))
        words, starts = sentences(text)
        assert list(starts) == sorted(set(starts)) and (not words or starts[0] == 0)
        assert all(b - a <= SENTENCE for a, b in zip(starts, [*starts[1:], len(words)], strict=False))
        assert all(len(w) <= PART for w in words) and len(words) >= len(text.split())

def plain_subsequences(string):
    """Subsequences of three to five characters within a span of five, by the rule and not by the library's patterns."""
    out = []
    for at in range(len(string)):
        for size in (3, 4, 5):
            for rest in itertools.combinations(range(at + 1, min(at + 5, len(string))), size - 1):
                gaps = rest[-1] - at + 1 - size
                weight = 0.7**gaps if size == 3 else {4: (1.5, 0.9), 5: (2.0,)}[size][gaps]
                out.append(("".join(string[i] for i in (at, *rest)), weight))
    return out


def test_kernel_and_landmark_space_against_plain_enumeration():
    known = ["idiot", "stupid", "moron", "table", "window", "a"]
    words = ["idiot", "idi-ot", "ixdiot", "stupidity", "morn", "tables", "wind", "a", "zzz", "größe"]
    vectors = {w: Counter() for w in {*known, *words}}
    for w, v in vectors.items():
        for s, weight in plain_subsequences(f"\1{w}\2"):
            v[s] += weight
    inner = lambda a, b: sum(x * vectors[b][s] for s, x in vectors[a].items())
    scale = {w: sum(x * x for _, x in plain_subsequences(f"\1{w}\2")) ** 0.25 for w in vectors}
    space = Landmarks(marked(known))
    assert space.size == len(known)
    # Where all landmarks' directions are kept, products with a landmark are the kernel itself.
    got = space.embed(words) @ space.embed(known).T
    want = np.array([[inner(a, b) / (scale[a] * scale[b]) for b in known] for a in words])
    assert np.allclose(got, want, atol=2e-3 * want.max())
    assert want[2, 0] > 0.5 * want[0, 0] and want[5, 0] == 0  # an inserted character does not break the likeness
    beta = np.random.default_rng(3).normal(size=space.size)
    assert np.allclose(margins(words, space.table(beta)), space.embed(words) @ beta, atol=1e-3)
