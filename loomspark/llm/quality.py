"""Quality rules with robust multivariate outlier rejection (operator 1).

Each text gives a vector of transformed statistics. Per language and source a minimum-covariance-determinant estimate of
centre and scatter is found by concentration steps over all rows, from two deterministic starts and until they converge:
a step measures all Mahalanobis distances, puts them into fine bins, sums moments by group and bin, and takes the closest
bins that hold the share `coverage`. The start of the smaller determinant is reweighted once. The same is done per
language and for all rows; a group's estimate is shrunk towards its language's and that towards the whole's by its rows,
so that small groups are judged by their own estimate as far as it carries. Rows beyond the chi-squared cut are rejected.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, SPACES, sliced, small, stage, unstage

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = np.frombuffer(b"#*$%&|<>", dtype=np.uint8)
WINDOW = 8
FEATURES = ["f_length", "f_symbols", "f_lines", "f_repeats", "f_upper"]
#: Standard deviations of the statistics' own noise. Distances are measured with the estimated scatter plus this, as a
#: constant feature would otherwise reject any change; the estimates are made without it.
FLOORS = [0.15, 0.045, 0.12, 0.12, 0.08]
P = len(FEATURES)
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
MOMENTS = ["cnt"] + [f"s{i}" for i in range(P)] + [f"q{i}{j}" for i, j in PAIRS]


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words that lie in a window of 8 words found twice or more, the first find included. Exact: windows get ids by doubling."""
    n = len(words)
    if n <= window:
        return 0
    ids = dict(zip(words, range(n), strict=True))
    if len(ids) == n:
        return 0
    x, step = np.fromiter(map(ids.__getitem__, words), np.int64, n), 1
    while step < window:
        x = x[:-step] * n + x[step:]
        _, x, counts = np.unique(x, return_inverse=True, return_counts=True)
        if len(counts) == len(x):
            return 0
        step *= 2
    starts = np.flatnonzero(counts[x] > 1)
    covered = np.zeros(n + 1, np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + window, -1)
    return int((np.cumsum(covered) > 0).sum())


def text_stats(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines with a word, upper-case A-Z."""
    if not text:
        return 0, 0, 0, 0, 0, 0, 0
    words = _WORD.findall(text)
    by_byte = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (
        len(words),
        sum(map(len, words)),
        int(by_byte[_SYMBOLS].sum()),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        int(by_byte[65:91].sum()),
    )


_STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the statistics of each whole text (null: no words). One pass, no shuffle."""

    def run(batches):
        for batch in sliced(batches):
            rows = [text_stats(t) for t in batch.column(3).to_pylist()]
            cols = list(zip(*rows, strict=True)) or [[]] * len(_STATS)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(3)] + [pa.array(c, pa.int64()) for c in cols], names=["doc_id", "lang", "source", *_STATS])

    t = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return docs.select("doc_id", "lang", "source", "text").mapInArrow(run, f"doc_id {t['doc_id']}, lang {t['lang']}, source {t['source']}, " + ", ".join(f"{c} long" for c in _STATS))


def features() -> list[Column]:
    """Rates are shrunk towards clean prose by a few pseudo-words, then variance-stabilised, so that short texts are not odd by chance."""
    c = F.col
    return [
        F.log((c("word_chars") + 200.0) / (c("n_words") + 40.0)).alias("f_length"),
        F.sqrt(c("n_symbols") / (c("word_chars") + 60.0)).alias("f_symbols"),
        F.sqrt(c("n_dup_lines") / (c("n_lines") + 4.0)).alias("f_lines"),
        F.sqrt(c("n_repeat_words") / (c("n_words") + 40.0)).alias("f_repeats"),
        F.sqrt(c("n_upper") / (c("word_chars") + 60.0)).alias("f_upper"),
    ]


def chi2_cdf(x: float, k: int) -> float:
    """For odd k; by the recurrence on k from the normal distribution."""
    total, term = math.erf(math.sqrt(x / 2)), math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for i in range(1, k, 2):
        total -= term
        term *= x / (i + 2)
    return total


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return (low + high) / 2


def _distance() -> Column:
    d = [F.col(f) - F.col(f"m{i}") for i, f in enumerate(FEATURES)]
    total = F.lit(0.0)
    for i, j in PAIRS:
        total = total + (1.0 if i == j else 2.0) * F.col(f"p{i}{j}") * d[i] * d[j]
    return F.greatest(total, F.lit(0.0))


_UPPER = ", ".join(f"p{i}{j} double" for i, j in PAIRS)
#: Centre, inverse scatter, and the logarithm of the scatter's determinant.
ESTIMATE = [*(f"m{i}" for i in range(P)), *(f"p{i}{j}" for i, j in PAIRS), "logdet"]
#: One row per group and start; moved: the last step still lowered the determinant.
_MODEL = "grp string, start int, n long, " + ", ".join(f"{c} double" for c in ESTIMATE) + ", moved boolean"
#: By how much a step must lower the determinant's logarithm for another to follow.
LEAST_GAIN = 1e-4


def _scatter(r: dict, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """Centre and scatter of the rows whose moments r holds. A singular scatter, and no other, gets a small ridge."""
    mean = np.array([r[f"s{i}"] for i in range(P)]) / r["cnt"]
    cov = np.zeros((P, P))
    for i, j in PAIRS:
        cov[i, j] = cov[j, i] = factor * (r[f"q{i}{j}"] / r["cnt"] - mean[i] * mean[j])
    ridge = np.diag(np.square(FLOORS)) * 1e-4
    if np.linalg.eigvalsh(cov / np.outer(FLOORS, FLOORS)).min() < 1e-8:
        cov = cov + ridge
    return mean, cov


def _step(factor: float):
    """From moments of the chosen rows of a group to its next model: the new one if its determinant is smaller, else the old."""

    def run(frames):
        for pdf in frames:
            out = []
            for r in pdf.to_dict("records"):
                old = dict(r["old"])
                mean, cov = _scatter(r, factor)
                logdet = float(np.linalg.slogdet(cov)[1])
                if logdet < old["logdet"]:
                    inverse = np.linalg.inv(cov)
                    fields = [*mean, *(inverse[i, j] for i, j in PAIRS), logdet]
                else:
                    fields = [old[c] for c in ESTIMATE]
                out.append([r["grp"], int(r["start"]), int(r["n"]), *fields, bool(logdet < old["logdet"] - LEAST_GAIN)])
            yield pd.DataFrame(out, columns=["grp", "start", "n", *ESTIMATE, "moved"])

    return run


def _moments() -> list[Column]:
    x = [F.col(f) for f in FEATURES]
    return [F.count(F.lit(1)).alias("cnt")] + [F.sum(v).alias(f"s{i}") for i, v in enumerate(x)] + [F.sum(x[i] * x[j]).alias(f"q{i}{j}") for i, j in PAIRS]


def _starts(rows: DataFrame) -> DataFrame:
    """Two models per group, from medians and quartiles: start 0 without correlations, start 1 with those of the
    hyperbolic tangents of the standardised features, which outliers move little."""
    quartiles = F.array(*map(F.lit, (0.25, 0.5, 0.75)))
    q = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), *(F.percentile(F.round(f, 3), quartiles).alias(f"q_{f}") for f in FEATURES))
    spread = [F.greatest((F.col(f"q_{f}")[2] - F.col(f"q_{f}")[0]) / 1.349, F.lit(s)).alias(f"d{i}") for i, (f, s) in enumerate(zip(FEATURES, FLOORS, strict=True))]
    q = stage(q.select("grp", "n", *(F.col(f"q_{f}")[1].alias(f"c{i}") for i, f in enumerate(FEATURES)), *spread), "mcd-quartiles")
    y = [F.tanh((F.col(f) - F.col(f"c{i}")) / F.col(f"d{i}")) for i, f in enumerate(FEATURES)]
    bent = rows.join(small(q), "grp").groupBy("grp").agg(F.count(F.lit(1)).alias("cnt"), *(F.sum(v).alias(f"s{i}") for i, v in enumerate(y)), *(F.sum(y[i] * y[j]).alias(f"q{i}{j}") for i, j in PAIRS))

    def both(frames):
        for pdf in frames:
            out = []
            for r in pdf.to_dict("records"):
                centre, scale = np.array([r[f"c{i}"] for i in range(P)]), np.array([r[f"d{i}"] for i in range(P)])
                cov = np.zeros((P, P))
                for i, j in PAIRS:
                    cov[i, j] = cov[j, i] = r[f"q{i}{j}"] / r["cnt"] - r[f"s{i}"] * r[f"s{j}"] / r["cnt"] ** 2
                sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
                corr = cov / np.outer(sd, sd)
                np.fill_diagonal(corr, 1.0)
                for start, c in ((0, np.eye(P)), (1, 0.95 * corr + 0.05 * np.eye(P))):
                    scatter = c * np.outer(scale, scale)
                    inverse = np.linalg.inv(scatter)
                    out.append([r["grp"], start, int(r["n"]), *centre, *(inverse[i, j] for i, j in PAIRS), math.inf, True])
            yield pd.DataFrame(out, columns=["grp", "start", "n", *ESTIMATE, "moved"])

    return stage(bent.join(q, "grp").mapInPandas(both, _MODEL), "mcd-start")


def _concentrate(rows: DataFrame, model: DataFrame, coverage: float) -> DataFrame:
    """One concentration step over all rows of the groups in `model`. Bins are 1/16 of a doubling of the squared distance wide."""
    near = rows.join(model, "grp").withColumn("bin", F.floor(16 * F.log2(_distance() + 1e-6)))
    by_bin = near.groupBy("grp", "start", "bin").agg(F.first("n").alias("n"), *_moments())
    upto = Window.partitionBy("grp", "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = by_bin.select("grp", "start", "n", "bin", *(F.sum(m).over(upto).alias(m) for m in MOMENTS)).filter(F.col("cnt") >= F.ceil(coverage * F.col("n")))
    chosen = sums.groupBy("grp", "start").agg(F.min_by(F.struct("n", *MOMENTS), "bin").alias("x")).select("grp", "start", "x.*")
    old = model.select("grp", "start", F.struct(*ESTIMATE).alias("old"))
    q = chi2_quantile(coverage, P)
    return chosen.join(old, ["grp", "start"]).mapInPandas(_step(coverage / chi2_cdf(q, P + 2)), _MODEL)


def raw_estimates(rows: DataFrame, coverage: float = 0.75) -> DataFrame:
    """The converged model of the smaller determinant per `grp`. Each group and start goes on by itself: a step that lowers
    its determinant by less than `LEAST_GAIN` is its last, and one that raises it, as bins are not quite exact, is not
    taken. Only the rows of groups that still move are measured again. As each further step lowers a determinant by at
    least that much, and ridges bound determinants from below, the search ends without a limit on its steps."""
    model = _starts(rows)
    while moving := model.agg(F.count_if("moved")).first()[0]:
        active, done = model.filter("moved"), model.filter("NOT moved")
        new = stage(_concentrate(rows, F.broadcast(active) if moving <= BROADCAST_ROWS else active, coverage).unionByName(done), "mcd")
        unstage(model)
        model = new
    best = model.groupBy("grp").agg(F.min_by(F.struct("n", *ESTIMATE), F.struct("logdet", "start")).alias("x"))
    return stage(best.select("grp", "x.*"), "mcd-raw")


def robust_estimates(rows: DataFrame, coverage: float = 0.75) -> DataFrame:
    """Moments of the rows within the 0.975 quantile of the raw estimates, per `grp`; n is the group's rows."""
    inner = rows.join(small(raw_estimates(rows, coverage)), "grp").filter(_distance() <= chi2_quantile(0.975, P))
    return stage(inner.groupBy("grp").agg(F.first("n").alias("n"), *_moments()), "mcd-final")


def _shrunk(prior: float):
    """From moments of a group, its language and the whole to the group's centre and inverse scatter with noise."""
    factor = 0.975 / chi2_cdf(chi2_quantile(0.975, P), P + 2)

    def run(frames):
        for pdf in frames:
            out = []
            for r in pdf.to_dict("records"):
                mean, cov = None, None
                for level in ("whole", "lang", "own"):
                    if r[level] is None:
                        continue
                    own_mean, own_cov = _scatter(dict(r[level]), factor)
                    share = 1.0 if mean is None else r[level]["n"] / (r[level]["n"] + prior)
                    mean = own_mean if mean is None else share * own_mean + (1 - share) * mean
                    cov = own_cov if cov is None else share * own_cov + (1 - share) * cov
                inverse = np.linalg.inv(cov + np.diag(np.square(FLOORS)))
                out.append([r["grp"], *mean, *(inverse[i, j] for i, j in PAIRS)])
            yield pd.DataFrame(out, columns=["grp", *(f"m{i}" for i in range(P)), *(f"p{i}{j}" for i, j in PAIRS)])

    return run


def quality(docs: DataFrame, cut: float = 0.999, coverage: float = 0.75, prior: float = 50.0) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance.

    base_failed: n_words < 20, or over 30 % of the words are in repeated 8-word windows. kept: not base_failed, and the
    squared Mahalanobis distance from the group's robust centre is at most the chi-squared quantile `cut`. Groups are
    language and source; estimates are made from rows with 20 words. A group of n rows counts n / (n + prior) against its
    language, and the language against the whole, at every size. Null text: no words, so base_failed. Null language or
    source: a group like any other. A group without any usable row is judged by its language's or the whole's estimate.
    Repeated rows count each; extra columns of docs are not read. An empty table gives an empty result.
    """
    stats = stage(statistics(docs), "quality-stats")
    name = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("null")) for c in ("lang", "source")]
    levels = {"own": F.concat_ws("\x1f", F.lit("own"), *name), "lang": F.concat_ws("\x1f", F.lit("lang"), name[0]), "whole": F.lit("whole")}
    rows = stats.select("doc_id", *_STATS, *(c.alias(n) for n, c in levels.items()), *features())
    every = rows.filter("n_words >= 20").select(*FEATURES, F.explode(F.array(*levels)).alias("grp"))
    moments = robust_estimates(every, coverage)
    packed = moments.select("grp", F.struct("n", *MOMENTS).alias("x"))
    # One row per language and source.
    groups = rows.groupBy("own", "lang", "whole").agg(F.count(F.lit(1)).alias("rows"))
    for level in levels:
        groups = groups.join(packed.select(F.col("grp").alias(level), F.col("x").alias(f"x_{level}")), level, "left")
    model = groups.filter("x_whole IS NOT NULL").select(F.col("own").alias("grp"), *(F.col(f"x_{level}").alias(level) for level in levels))
    model = stage(model.mapInPandas(_shrunk(prior), "grp string, " + ", ".join(f"m{i} double" for i in range(P)) + f", {_UPPER}"), "mcd-shrunk")
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    far = F.coalesce(F.col("distance") > chi2_quantile(cut, P), F.lit(False))
    out = rows.join(small(model), F.col("own") == F.col("grp"), "left").withColumn("distance", _distance())
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & ~far).alias("kept"), "distance")
