import itertools
import math
import random
import re

import numpy as np
import pytest

from loomspark.llm import quality as q


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def test_statistics_equal_brute_force():
    rng = random.Random(6)
    for _ in range(400):
        text = "".join(rng.choices(["a ", "b ", "é ", "\n", "c\n", "# ", "|", "x\ty ", " ", "\x0b"], k=rng.randrange(0, 60)))
        assert q.text_stats(text)[:5] == brute(text), repr(text)
    assert q.text_stats(None)[:5] == (0, 0, 0, 0, 0)


def test_chi2():
    assert q.chi2_quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-3) and q.chi2_cdf(7.815, 3) == pytest.approx(0.95, abs=1e-4)


def test_estimates_resist_contamination(spark):
    rng = np.random.default_rng(1)
    clean = rng.normal(0.5, 0.2, (900, q.P))
    bad = rng.normal(4.0, 0.1, (100, q.P))
    rows = [("g", *map(float, r)) for r in np.vstack([clean, bad])]
    model = q.raw_estimates(spark.createDataFrame(rows, "grp string, " + ", ".join(f"{f} double" for f in q.FEATURES))).first()
    assert [model[f"m{i}"] for i in range(q.P)] == pytest.approx([0.5] * q.P, abs=0.05)


def test_rejects_junk_and_keeps_prose(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("etaoinshr", k=rng.randint(1, 9)))
    prose = lambda n: ". ".join(" ".join(word() for _ in range(12)).capitalize() for _ in range(n))
    rows = [(i, prose(rng.randint(2, 40)), "en", "a" if i % 3 else f"s{i % 9}") for i in range(400)]
    rows += [(1000 + i, " ".join(f"{word()}***" for _ in range(60)), "en", "a") for i in range(15)]
    rows += [(2000 + i, prose(8).upper(), "en", "a") for i in range(15)]
    got = {r.doc_id: r for r in q.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert len(got) == 430 and all(got[i].kept for i in range(400))
    assert not any(got[i].kept for i in got if i >= 1000) and not any(r.base_failed for r in got.values())


def test_odd_rows(spark, odd_docs):
    got = q.quality(odd_docs).collect()
    assert len(got) == 8 and {(r.doc_id, r.base_failed, r.kept) for r in got} == {(i, True, False) for i in (1, 2, 3, 4, 5, None, 7)}
    assert q.quality(odd_docs.limit(0)).count() == 0


def test_cut_is_the_customary_quantile(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("etaoinshr", k=rng.randint(1, 9)))
    rows = [(i, " ".join(word() for _ in range(150)), "en", "a") for i in range(300)]
    rows += [(1000 + k, " ".join(word() + "*" * (i < k) for i in range(150)), "en", "a") for k in range(1, 60, 2)]
    got = q.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    cut, loose = q.chi2_quantile(0.999, q.P), q.chi2_quantile(1 - 1e-7, q.P)
    assert any(cut < r.distance <= loose for r in got)
    assert all(r.kept == (not r.base_failed and r.distance <= cut) for r in got)


def test_small_groups_reach_the_least_determinant(spark):
    """Against every subset of three quarters of the rows."""
    rng, rows, best = np.random.default_rng(5), [], {}
    mix = rng.normal(0, 0.4, (q.P, q.P)) + np.eye(q.P)
    for g in range(6):
        x = rng.normal(0, 1, (16, q.P)) @ mix
        x[:3] += 12
        rows += [(f"g{g}", *map(float, r)) for r in x]
        dets = [(float(np.linalg.slogdet(np.cov(x[list(s)].T, bias=True))[1]), s) for s in itertools.combinations(range(16), 12)]
        best[f"g{g}"] = min(dets)
    got = q.raw_estimates(spark.createDataFrame(rows, "grp string, " + ", ".join(f"{f} double" for f in q.FEATURES))).collect()
    factor = q.P * math.log(0.75 / q.chi2_cdf(q.chi2_quantile(0.75, q.P), q.P + 2))
    assert len(got) == 6
    for r in got:  # bins can take a row more than three quarters, so the determinant may be somewhat above the least
        assert r.logdet - factor <= best[r.grp][0] + 1.0 and not set(range(3)) & set(best[r.grp][1])
        assert all(abs(r[f"m{i}"]) < 2 for i in range(q.P))


def test_verdict_equals_brute_force(spark):
    """distance and kept, made again with numpy from the moments of the reweighted estimates."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("etaoinshr", k=rng.randint(1, 9)))
    rows = [(i, " ".join(word() + "*" * (i % 37 == 0) for _ in range(rng.randint(10, 150))), rng.choice(["en", None]), rng.choice("ab")) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in q.quality(docs).collect()}
    stats = q.statistics(docs).select("doc_id", "lang", "source", "n_words", *q.features()).toPandas()
    names = {"own": lambda r: (r.lang, r.source), "lang": lambda r: r.lang, "whole": lambda r: 0}
    use = stats[stats.n_words >= 20]
    moments = {}
    for level, of in names.items():
        keys = use.apply(lambda r: repr(of(r)), axis=1)  # noqa: B023
        for k in sorted(set(keys)):
            x = use[keys == k]
            frame = spark.createDataFrame([(k, *map(float, v)) for v in x[q.FEATURES].to_numpy()], "grp string, " + ", ".join(f"{f} double" for f in q.FEATURES))
            moments[level, k] = q.robust_estimates(frame).first().asDict()
    factor, noise = 0.975 / q.chi2_cdf(q.chi2_quantile(0.975, q.P), q.P + 2), np.diag(np.square(q.FLOORS))
    for r in stats.sample(40, random_state=1).itertuples():
        mean = cov = None
        for level in ("whole", "lang", "own"):
            m = moments.get((level, repr(names[level](r))))
            if m:
                own_mean, own_cov = q._scatter(m, factor)
                share = 1 if mean is None else m["n"] / (m["n"] + 50)
                mean, cov = (own_mean, own_cov) if mean is None else (share * own_mean + (1 - share) * mean, share * own_cov + (1 - share) * cov)
        d = np.array([getattr(r, f) for f in q.FEATURES]) - mean
        distance = d @ np.linalg.inv(cov + noise) @ d
        assert got[r.doc_id].distance == pytest.approx(distance, rel=1e-6)
        assert got[r.doc_id].kept == (not got[r.doc_id].base_failed and distance <= q.chi2_quantile(0.999, q.P))
