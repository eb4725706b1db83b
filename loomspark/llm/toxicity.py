"""Toxicity by a subsequence string kernel and Nystroem landmarks (operator 5).

Two words are alike as far as they share subsequences of three to five characters, ends marked: a skipped character
lowers a subsequence's weight, so an inserted character lowers the likeness but does not break it, and longer unbroken
ones weigh more, so that a stem shared by long words counts. Two sentences are alike by the sum over their words. A
support vector machine is trained on the sentences of labelled texts, each with its text's label, in the space that
landmarks span: short strings that toxic texts hold far oftener than others, and words of the other texts. A logistic
model pools the margins of a text's sentences, as no label says which sentence is meant.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sliced, stage, unstage

SPAN, DECAY, BITS = 5, 0.7, 18
#: Offsets of a subsequence's characters, and its weight.
PATTERNS = [((0, a, b), DECAY ** (b - 2)) for b in range(2, SPAN) for a in range(1, b)]
PATTERNS += [((0, 1, 2, 3), 1.5), ((0, 1, 2, 4), 0.9), ((0, 1, 3, 4), 0.9), ((0, 2, 3, 4), 0.9), ((0, 1, 2, 3, 4), 2.0)]
#: Bound of the training sample: labelled texts.
MAX_TEXTS = 8_000
#: Landmarks of each kind, and dimensions of the space they span.
LANDMARKS, RANK = 80, 144
#: Lengths of the strings that can be landmarks, and how many of the most frequent in toxic texts are compared.
GRAMS, CANDIDATES = (4, 6), 50_000
#: Words of a sentence; longer sentences are cut. Characters of a word; longer words are cut into overlapping parts.
SENTENCE, PART = 8, 32
_SPACED = re.compile(r"(?<!\S)\w(?: \w){2,}(?!\S)")
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_INNER = re.compile(f"[{re.escape(_EDGES)}]+")
NOTHING = -2.0  # margin of a text without words
LEVELS = np.array([[-0.3], [0.0], [0.3], [0.6]])


def _patterns(strings: list[str]) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray, float]]]:
    """Where each string starts in their joined characters; and for each pattern the hashed subsequence at every
    character, whether it lies within a string, and the pattern's weight."""
    gap = "\0" * (SPAN - 1)
    starts = np.cumsum([0, *(len(m) + SPAN - 1 for m in strings[:-1])])
    codes = np.frombuffer((gap.join(strings) + gap).encode("utf-32-le", "surrogatepass"), np.uint32)
    n, padded = len(codes), np.concatenate([codes, np.zeros(SPAN, np.uint32)])
    spread = padded * np.uint32(0x9E3779B1)
    spread ^= spread >> np.uint32(15)
    inside = [padded[o : o + n] != 0 for o in range(SPAN)]

    def each():
        for offsets, weight in PATTERNS:
            h, known = spread[:n], inside[0]
            for o in offsets[1:]:
                h = h * np.uint32(0x85EBCA77) + spread[o : o + n]
                known = known & inside[o]
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * len(offsets))
            yield (h ^ (h >> np.uint32(13))) >> np.uint32(32 - BITS), known, weight

    return starts, each()


def subsequences(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, weight) of the subsequences of strings."""
    starts, each = _patterns(strings)
    at, col, weight = [], [], []
    for h, known, w in each:
        at.append(np.flatnonzero(known))
        col.append(h[known])
        weight.append(np.full(len(at[-1]), w, np.float32))
    return np.searchsorted(starts, np.concatenate(at), "right") - 1, np.concatenate(col), np.concatenate(weight)


def marked(words: list[str]) -> list[str]:
    return [f"\1{w}\2" for w in words]


def _scale(row: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Per word the fourth root of its kernel with itself: long words are scaled down, but not to one length."""
    return np.sqrt(np.sqrt(np.maximum(np.bincount(row, weight**2, n), 1e-12))).astype(np.float32)


class Landmarks:
    """The Nystroem space of some strings: \\1 and \\2 in them mark where a word begins and ends."""

    def __init__(self, strings: list[str]):
        row, col, weight = subsequences(strings)
        self.used, at = np.unique(col, return_inverse=True)
        phi = np.zeros((len(self.used), len(strings)), np.float32)
        np.add.at(phi, (at, row), weight)
        self.phi = phi / np.maximum(np.linalg.norm(phi, axis=0), 1e-12)
        values, vectors = np.linalg.eigh((self.phi.T @ self.phi).astype(np.float64))
        keep = np.flatnonzero(values > 1e-4 * values.max())[-RANK:]
        self.root = (vectors[:, keep] / np.sqrt(values[keep])).astype(np.float32)
        self.size = len(keep)

    def embed(self, words: list[str]) -> np.ndarray:
        row, col, weight = subsequences(marked(words))
        scale = _scale(row, weight, len(words))
        at = np.minimum(np.searchsorted(self.used, col), len(self.used) - 1)
        hit = np.flatnonzero(self.used[at] == col)
        kernel = np.zeros((len(words), self.phi.shape[1]), np.float32)
        if len(hit):
            hit = hit[np.argsort(row[hit], kind="stable")]
            row, part = row[hit], self.phi[at[hit]] * weight[hit, None]
            first = np.flatnonzero(np.diff(row, prepend=-1))
            kernel[row[first]] = np.add.reduceat(part, first)
        return kernel / scale[:, None] @ self.root

    def table(self, beta: np.ndarray) -> np.ndarray:
        """The weight of each hashed subsequence, from the weights of this space."""
        out = np.zeros(1 << BITS, np.float32)
        np.add.at(out, self.used, self.phi @ (self.root @ beta.astype(np.float32)))
        return out


def margins(words: list[str], table: np.ndarray) -> np.ndarray:
    """What each word adds to the decision value of its sentence."""
    starts, each = _patterns(marked(words))
    total, norm = 0.0, 0.0
    for h, known, weight in each:
        total = total + known * (np.float32(weight) * table[h])
        norm = norm + known * np.float32(weight**2)
    return np.add.reduceat(total, starts) / np.sqrt(np.sqrt(np.maximum(np.add.reduceat(norm, starts), 1e-12)))


def sentences(text: str | None) -> tuple[list[str], np.ndarray]:
    """The words of a text in lower case, and where its sentences start: behind a word with . ! or ?, or after 8 words."""
    low = text.lower() if text else ""
    raw = low.split()
    ends = [w[-1] in ".!?" for w in raw]
    words = [w.strip(_EDGES) or w for w in raw]
    for m in _SPACED.findall(low):  # letters set apart by spaces are a word, too
        words.append(m.replace(" ", ""))
        ends.append(True)
    if words and max(map(len, words)) > PART:
        cut = [[w[k : k + PART] for k in range(0, max(1, len(w) - PART // 2), PART // 2)] if len(w) > PART else [w] for w in words]
        ends = [e for parts, end in zip(cut, ends, strict=True) for e in [False] * (len(parts) - 1) + [end]]
        words = [w for parts in cut for w in parts]
    at, new = np.arange(len(words)), np.ones(len(words), bool)
    new[1:] = ends[:-1]
    return words, np.flatnonzero((at - np.maximum.accumulate(np.where(new, at, 0))) % SENTENCE == 0)


class Scorer:
    """Sentence margins of texts. Keeps up to `limit` words' shares, then starts anew."""

    def __init__(self, table: np.ndarray, bias: float, limit: int = 100_000):
        self.table, self.bias, self.limit, self.known = table, bias, limit, {}

    def sentence_margins(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The margin of each sentence of each text. Words are looked up for all texts at once; there should be few texts."""
        cut = [sentences(t) for t in texts]
        new = [w for w in dict.fromkeys(w for words, _ in cut for w in words) if w not in self.known]
        if len(self.known) + len(new) > self.limit:
            self.known = {}
            new = list(dict.fromkeys(w for words, _ in cut for w in words))
        for a in range(0, len(new), 5_000):
            some = new[a : a + 5_000]
            best = margins(some, self.table)
            inner = [(i, v) for i, w in enumerate(some) if not w.isalnum() and (v := _INNER.sub("", w)) and v != w]
            if inner:  # signs within a word may hide it
                at = [i for i, _ in inner]
                best[at] = np.maximum(best[at], margins([v for _, v in inner], self.table))
            self.known.update(zip(some, best.tolist(), strict=True))
        for words, starts in cut:
            share = np.fromiter(map(self.known.__getitem__, words), np.float64, len(words))
            yield np.add.reduceat(share, starts) + self.bias if words else share

    def pool(self, texts: list[str | None]) -> np.ndarray:
        """Per text: its three highest margins, logs of the counts above four levels, the log of all, and ratios of logs."""
        out = np.empty((len(texts), 12))
        for i, m in enumerate(self.sentence_margins(texts)):
            top = np.sort(np.append(m, [NOTHING] * 3))[:-4:-1]
            over, size = np.log1p((m > LEVELS).sum(1)), np.log(SENTENCE * len(m) + 10)
            out[i] = [*np.clip(top, NOTHING, 3), *over, size, *over / size]
        return out


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Ridge logistic regression of standardised columns, by Newton steps: weights of the columns as given, and intercept."""
    mean, spread = x.mean(0), x.std(0) + 1e-6
    z = np.hstack([(x - mean) / spread, np.ones((len(x), 1))])
    beta, ridge = np.zeros(z.shape[1]), penalty * np.diag([1.0] * (z.shape[1] - 1) + [1e-3])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    weights = beta[:-1] / spread
    return np.append(weights, beta[-1] - weights @ mean)


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4. Fold 2 is held out, fold 3 calibrates, folds 0 and 1 teach the machine."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")), F.lit(0)) % 4


def _gram_counts(texts: DataFrame, among: frozenset[str] | None = None) -> DataFrame:
    """(gram, pos, n): toxic texts and all texts with a word that holds a short string, of those in `among` if given."""

    def run(batches):
        counts: dict[str, list[int]] = {}

        def flush():
            cols = [pa.array(list(counts)), pa.array([v[0] for v in counts.values()], pa.int64()), pa.array([v[1] for v in counts.values()], pa.int64())]
            counts.clear()
            return pa.RecordBatch.from_arrays([cols[0].cast(pa.string()), *cols[1:]], names=["gram", "pos", "n"])

        for batch in sliced(batches):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found: set[str] = set()
                for m in marked(list(set(sentences(text)[0]))):
                    found.update(m[i : i + k] for k in GRAMS for i in range(len(m) - k + 1))
                for g in found if among is None else found & among:
                    c = counts.setdefault(g, [0, 0])
                    c[0] += toxic
                    c[1] += 1
            if len(counts) > 300_000:
                yield flush()
        yield flush()

    rows = texts.select("text", F.col("toxic").cast("long").alias("toxic")).mapInArrow(run, "gram string, pos long, n long")
    return rows.groupBy("gram").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))


def _landmarks(teach: DataFrame, n_pos: int, n_all: int) -> list[str]:
    """Short strings of high likelihood ratio, without those that say the same, and words of texts that are not toxic."""
    share = n_pos / n_all
    frequent = _gram_counts(teach.filter("toxic > 0")).filter("pos > 2").orderBy(F.desc("pos"), "gram").limit(CANDIDATES)
    counts = _gram_counts(teach, frozenset(r.gram for r in frequent.select("gram").collect()))
    pos, neg = F.col("pos"), F.col("n") - F.col("pos")
    gain = pos * F.log(pos / (F.col("n") * share)) + neg * F.log(F.greatest(neg, F.lit(0.5)) / (F.col("n") * (1 - share)))
    ranked = counts.filter((pos > 2) & (pos > 1.5 * share * F.col("n"))).orderBy(F.desc(gain), "gram").limit(40 * LANDMARKS).collect()
    chosen: list[tuple[str, int]] = []
    for r in ranked:
        parts = {r.gram[i : i + 3] for i in range(len(r.gram) - 2)}
        if len(chosen) < LANDMARKS and not any(0.8 * k <= r.pos <= 1.25 * k and any(p in g for p in parts) for g, k in chosen):
            chosen.append((r.gram, r.pos))
    words = teach.filter("toxic = 0").select(F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+")).alias("w"))
    words = words.select(F.substring(F.btrim("w", F.lit(_EDGES)), 1, PART).alias("w")).filter("w != ''")
    others = words.distinct().orderBy(F.xxhash64("w"), "w").limit(LANDMARKS).collect()
    return [g for g, _ in chosen] + marked([r.w for r in others]) if chosen else []


def _train(teach: DataFrame, space: Landmarks, penalty: float = 1e-5) -> np.ndarray:
    """Weights and bias of a squared-hinge machine over sentences. Newton steps are sums over sentences, made by Spark."""
    spark = teach.sparkSession
    sent = spark.sparkContext.broadcast(space)  # at most 2 * LANDMARKS short strings

    def embed(batches):
        for batch in sliced(batches):
            cut = [sentences(t) for t in batch.column(0).to_pylist()]
            place: dict[str, int] = {}
            for words, _ in cut:
                for w in words:
                    place.setdefault(w, len(place))
            vocabulary = list(place)
            table = [sent.value.embed(vocabulary[a : a + 500]) for a in range(0, len(vocabulary), 500)]
            table = np.vstack(table) if table else None
            for (words, starts), toxic in zip(cut, batch.column(1).to_pylist(), strict=True):
                at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
                for a in range(0, len(starts), 1_000):
                    first, last = starts[a], starts[a + 1_000] if a + 1_000 < len(starts) else len(words)
                    x = np.add.reduceat(table[at[first:last]], starts[a : a + 1_000] - first).astype(np.float16)
                    yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), pa.array(np.full(len(x), toxic), pa.int32())], names=["x", "toxic"])

    rows = stage(teach.select("text", "toxic").mapInArrow(embed, "x binary, toxic int"), "sentences")
    sizes = {r.toxic > 0: r.k for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("k")).collect()}
    if len(sizes) < 2:
        return np.zeros(space.size + 1)
    total, d = sum(sizes.values()), space.size + 1
    ridge = penalty * total * np.diag([1.0] * (d - 1) + [1e-6])

    def moments(beta: np.ndarray):
        def run(batches):
            square, linear = np.zeros((d, d)), np.zeros(d)
            for batch in batches:
                column = batch.column(0)
                if not len(column):
                    continue
                x = np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(len(column), -1).astype(np.float32)
                x = np.hstack([x, np.ones((len(x), 1), np.float32)])
                y = np.where(batch.column(1).to_numpy() > 0, 1.0, -1.0)
                active = 1 - y * (x @ beta) > 0
                x, y = x[active], y[active]
                weighted = x * np.where(y > 0, total / (2 * sizes[True]), total / (2 * sizes[False]))[:, None].astype(np.float32)
                square += weighted.T @ x
                linear += weighted.T @ y
            yield pa.RecordBatch.from_arrays([pa.array([square.tobytes()]), pa.array([linear.tobytes()])], names=["a", "b"])

        return run

    beta = np.zeros(d)
    for _ in range(12):
        parts = rows.coalesce(8).mapInArrow(moments(beta), "a binary, b binary").collect()  # at most 8 matrices of d x d
        square = sum(np.frombuffer(p.a).reshape(d, d) for p in parts)
        new = np.linalg.solve(square + ridge, sum(np.frombuffer(p.b) for p in parts))
        moved = np.abs(new - beta).max()
        beta = new
        if moved < 1e-4:
            break
    unstage(rows)
    return beta


def fit(docs: DataFrame, labels: DataFrame, max_texts: int = MAX_TEXTS) -> tuple:
    """(table, bias, pooling) from at most about max_texts labelled texts outside fold 2, chosen by a hash of their id.

    Ids with two different labels are left out. Without labels of both kinds, the model is their share alone.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(fold() != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("toxic").alias("other")).filter("toxic = other").drop("other")
    known = stage(known, "labels")
    n = known.count()
    known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, max_texts / max(n, 1))))
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # about max_texts rows
    texts = stage(texts.repartition(16), "labelled")
    teach = texts.filter(fold() != 3)
    n_pos, n_all = teach.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    n_pos = n_pos or 0
    nothing = None, 0.0, n_pos / max(n_all, 1)
    if not 0 < n_pos < n_all or not (strings := _landmarks(teach, n_pos, n_all)):
        return nothing
    space = Landmarks(strings)
    beta = _train(teach, space)
    model = space.table(beta[:-1]), float(beta[-1])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def pooled(batches):
        scorer = Scorer(*sent.value)
        for batch in sliced(batches):
            x = scorer.pool(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column(1).cast(pa.int32())], names=["x", "toxic"])

    sample = texts.filter(fold() == 3)
    if sample.agg(F.countDistinct("toxic")).first()[0] < 2:
        sample = texts
    rows = sample.select("text", "toxic").mapInArrow(pooled, "x binary, toxic int").collect()  # a row per labelled text
    unstage(texts)
    return *model, logistic(np.stack([np.frombuffer(r.x) for r in rows]), np.array([float(r.toxic > 0) for r in rows]))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_texts: int = MAX_TEXTS) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (score >= threshold).

    Null, empty and blank texts have no words and get the model's score for that. A null id is in fold 0. Repeated rows
    are kept, extra columns not read. Whole texts are scored; only the text enters a score.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_texts))

    def score(batches):
        table, bias, beta = sent.value
        scorer = Scorer(table, bias) if table is not None else None
        for batch in sliced(batches):
            if scorer is None:
                p = np.full(batch.num_rows, beta)
            else:
                p = 1 / (1 + np.exp(-np.clip(scorer.pool(batch.column(1).to_pylist()) @ beta[:-1] + beta[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double")
    return scored.select("doc_id", (fold() == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """docs without those predicted toxic. Rows that share an id go if any of them is; rows without an id stay."""
    bad = stage(toxicity(docs, labels, threshold).filter("predicted = 1").select("doc_id").distinct(), "toxic")
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)
