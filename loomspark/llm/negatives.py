"""Hard negatives by segment summaries (operator 13).

Vectors are stored in packed blocks together with summaries: for 4 and for 16 segments of a vector, each segment's mean
and deviation. With m and d the mean and deviation of a segment, scaled by the root of its length, m * m' + d * d' and
m * m' - d * d' bound the segment's part of an inner product (Cauchy and Schwarz). Bounds over few segments drop what
cannot enter a ranking, those over more segments refine what is left, and only the rest is scored exactly.

The anchors' blocks and the rows' blocks meet on a grid; each cell keeps the few best of each anchor, and Spark ranks
those. The first grid finds each anchor's positives, the second the negatives within the positives' score bands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import sliced, stage, unstage

#: Segments of the summaries, coarse to fine.
LEVELS = (4, 16)
#: Components of the anchors of one cell and of the rows of one cell; pairs that a cell compares at once.
ANCHOR_CELL, ROW_CELL, PAIRS = 1 << 19, 1 << 20, 1 << 21
#: Rows with a squared norm from here on take no part: their scores might not fit a long.
MOST_NORM = 2.0**62
_NONE = np.iinfo(np.int64).min


def segments(dim: int, count: int) -> np.ndarray:
    """Where the segments of a vector begin."""
    return np.arange(min(count, dim)) * dim // max(min(count, dim), 1)


def summary(vectors: np.ndarray) -> np.ndarray:
    """Per row the scaled means and deviations of its segments, level after level."""
    dim, out = vectors.shape[1], []
    for count in LEVELS if dim else ():
        at = segments(dim, count)
        length = np.diff(np.append(at, dim))
        mean = np.add.reduceat(vectors, at, axis=1) / length
        off = vectors - np.repeat(mean, length, axis=1)
        out += [mean * np.sqrt(length), np.sqrt(np.add.reduceat(off * off, at, axis=1))]
    return np.concatenate(out, axis=1).astype(np.float32) if out else np.empty((len(vectors), 0), np.float32)


class Block:
    """Vectors of one dimension with ids, labels and summaries."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, summaries: np.ndarray):
        self.ids, self.labels, self.vectors, self.summaries = ids, labels, vectors, summaries

    def take(self, at) -> Block:
        return Block(self.ids[at], self.labels[at], self.vectors[at], self.summaries[at])

    def levels(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        dim, a = self.vectors.shape[1], 0
        for count in LEVELS if dim else ():
            k = min(count, dim)
            yield self.summaries[:, a : a + k], self.summaries[:, a + k : a + 2 * k]
            a += 2 * k

    def norm(self) -> float:
        v = self.vectors.astype(np.float64)
        return float(np.sqrt((v * v).sum(1).max())) if v.size else 0.0

    @staticmethod
    def joined(blocks: list[Block]) -> Block:
        return Block(*(np.concatenate([getattr(b, x) for b in blocks]) for x in ("ids", "labels", "vectors", "summaries")))

    def packed(self) -> dict:
        small = not self.vectors.size or np.abs(self.vectors).max() < 2**15
        return {"dim": self.vectors.shape[1], "ids": self.ids.tobytes(), "labels": self.labels.tobytes(), "vectors": self.vectors.astype(np.int16 if small else np.int64).tobytes(), "small": bool(small), "summaries": self.summaries.tobytes()}

    @staticmethod
    def unpacked(row: dict) -> Block:
        ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        vectors = np.frombuffer(row["vectors"], np.int16 if row["small"] else np.int64).reshape(len(ids), row["dim"])
        return Block(ids, labels, vectors, np.frombuffer(row["summaries"], np.float32).reshape(len(ids), -1))


_PACKED = "dim int, ids binary, labels binary, vectors binary, small boolean, summaries binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, label, v) as packed blocks, one for each dimension of a slice."""
    schema = pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("vectors", pa.binary()), ("small", pa.bool_()), ("summaries", pa.binary())])
    for batch in sliced(batches, 1 << 20):
        ids, labels = (batch.column(i).to_numpy().astype(np.int64) for i in (0, 1))
        column = batch.column(2)
        flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        sizes, rows = np.diff(offsets), []
        for dim in np.unique(sizes):
            at = np.flatnonzero(sizes == dim)
            v = np.floor(256 * flat[offsets[at][:, None] + np.arange(dim)].astype(np.float64))
            with np.errstate(over="ignore"):
                fits = (v * v).sum(1) < MOST_NORM
            if fits.any():
                rows.append(Block(ids[at][fits], labels[at][fits], v[fits].astype(np.int64), summary(v[fits])).packed())
        yield pa.RecordBatch.from_pylist(rows, schema)


def exact(a: np.ndarray, b: np.ndarray, most: float, pairs: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Integer inner products, of all pairs or of the rows named. most: an upper bound of their size, which all partial
    sums keep to, so that floats below their exact range are exact."""
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
    if pairs is None:
        return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    out = np.empty(len(pairs[0]), np.int64)
    step = max(1, PAIRS // max(a.shape[1], 1))
    for s in range(0, len(out), step):
        out[s : s + step] = np.einsum("ij,ij->i", a[pairs[0][s : s + step]].astype(kind), b[pairs[1][s : s + step]].astype(kind))
    return out


class Best:
    """The k best (score, id) per anchor and band so far; ids arrive in rising order, so equal scores never displace."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        self.row, self.band, self.score, self.id = (np.empty(0, np.int64) for _ in range(4))

    def least(self) -> np.ndarray:
        """What a score must reach, per anchor and band."""
        held = np.zeros(self.low.shape, np.int64)
        np.add.at(held, (self.row, self.band), 1)
        last = np.full(self.low.shape, np.iinfo(np.int64).max, np.int64)
        np.minimum.at(last, (self.row, self.band), self.score)
        return np.where(held >= self.k, np.maximum(self.low, last + 1), self.low)

    def add(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        least, parts = self.least(), []
        for band in range(self.low.shape[1]):
            ok = (score >= least[row, band]) & (score <= self.high[row, band])
            parts.append((row[ok], np.full(ok.sum(), band, np.int64), score[ok], ids[ok]))
        own = (self.row, self.band, self.score, self.id)
        row, band, score, ids = (np.concatenate([x, *(p[i] for p in parts)]) for i, x in enumerate(own))
        order = np.lexsort((ids, -score, band, row))
        row, band, score, ids = row[order], band[order], score[order], ids[order]
        fresh = np.concatenate([[True], (row[1:] != row[:-1]) | (band[1:] != band[:-1])]) if len(row) else np.empty(0, bool)
        start = np.maximum.accumulate(np.where(fresh, np.arange(len(row)), 0))
        keep = np.arange(len(row)) - start < self.k
        self.row, self.band, self.score, self.id = row[keep], band[keep], score[keep], ids[keep]


def rank(anchors: Block, rows: Block, best: Best, counts: np.ndarray | None = None) -> None:
    """Put rows (in rising order of ids) into the rankings of the anchors; a row with an anchor's id is not ranked for it.

    counts: receives the pairs met and the pairs scored exactly.
    """
    most = anchors.norm() * rows.norm()
    slack = 1 + 1e-4 * most  # the summaries' and their products' rounding
    own = list(anchors.levels())
    at, step = 0, 256
    while at < len(rows.ids):
        part = rows.take(slice(at, at + step))
        at, step = at + step, max(1, PAIRS // max(len(anchors.ids), 1))
        least, high = best.least().min(1), best.high.max(1)
        ok, pairs = anchors.ids[:, None] != part.ids, None
        for (m, d), (mine, off) in zip(own, part.levels(), strict=True):
            if pairs is None:
                middle, reach = m @ mine.T, d @ off.T + np.float32(slack)
                ok &= (middle + reach >= least[:, None]) & (middle - reach <= high[:, None])
                if 4 * np.count_nonzero(ok) < ok.size:
                    pairs = np.nonzero(ok)
            else:
                i, j = pairs
                middle, reach = np.einsum("ij,ij->i", m[i], mine[j]), np.einsum("ij,ij->i", d[i], off[j]) + np.float32(slack)
                keep = (middle + reach >= least[i]) & (middle - reach <= high[i])
                pairs = i[keep], j[keep]
        if pairs is None:
            score, (i, j) = exact(anchors.vectors, part.vectors, most), np.nonzero(ok)
            score = score[i, j]
        else:
            i, j = pairs
            score = exact(anchors.vectors, part.vectors, most, pairs)
        if counts is not None:
            counts += [ok.size, len(score)]
        best.add(i, score, part.ids[j])


def _cell(anchors: list[dict], rows: list[dict], k: int, same: bool) -> dict:
    """The best k of a cell per anchor and band: of the anchor's label, or of all others. Blocks of one dimension meet."""
    out: dict[str, list[np.ndarray]] = {"anchor_id": [], "band": [], "score": [], "vec_id": []}
    for dim in {r["dim"] for r in anchors} & {r["dim"] for r in rows}:
        mine = [r for r in anchors if r["dim"] == dim]
        a, b = Block.joined([Block.unpacked(r) for r in mine]), Block.joined([Block.unpacked(r) for r in rows if r["dim"] == dim])
        b = b.take(np.argsort(b.ids, kind="stable"))
        low, high = (np.concatenate([np.frombuffer(r[x], np.int64).reshape(-1, r["bands"]) for r in mine]) for x in ("low", "high"))
        for label in np.unique(a.labels):
            at = np.flatnonzero(a.labels == label)
            best = Best(low[at], high[at], k)
            rank(a.take(at), b.take((b.labels == label) == same), best)
            for name, x in zip(out, (a.ids[at][best.row], best.band, best.score, best.id), strict=True):
                out[name].append(x)
    return {name: np.concatenate(x) if x else np.empty(0, np.int64) for name, x in out.items()}


def _grid(anchors: DataFrame, blocks: DataFrame, groups: int, k: int, same: bool) -> DataFrame:
    """(anchor_id, band, score, vec_id): the best k of every cell, from packed anchors (with bands) and packed rows."""
    sides = anchors.count()
    left = anchors.select(F.monotonically_increasing_id().alias("one"), *anchors.columns)
    left = stage(left.withColumn("side", F.pmod(F.xxhash64("one"), F.lit(sides)).cast("int")), "anchors") if sides else left.withColumn("side", F.lit(0))
    left = left.drop("one").withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = blocks.withColumn("side", F.explode(F.sequence(F.lit(0), F.lit(max(sides, 1) - 1))))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return pa.table(_cell(a.to_pylist(), b.to_pylist(), k, same))

    return left.groupBy("side", "group").cogroup(right.groupBy("side", "group")).applyInArrow(run, "anchor_id long, band long, score long, vec_id long")


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, label, v, lows, highs) as packed anchors with their bands, blocks of at most ANCHOR_CELL components."""
    held, size = [], 0

    def out() -> Iterator[pa.RecordBatch]:
        for dim in sorted({len(r["v"]) for r in held}):
            rows = [r for r in held if len(r["v"]) == dim]
            v = np.floor(256 * np.array([r["v"] for r in rows], np.float64).reshape(len(rows), dim))
            fits = (v * v).sum(1) < MOST_NORM
            rows, v = [r for r, ok in zip(rows, fits, strict=True) if ok], v[fits]
            if not rows:
                continue
            block = Block(np.array([r["vec_id"] for r in rows], np.int64), np.array([r["label"] for r in rows], np.int64), v.astype(np.int64), summary(v)).packed()
            width = max(len(r["lows"]) for r in rows)
            low, high = np.full((len(rows), width), np.iinfo(np.int64).max, np.int64), np.full((len(rows), width), _NONE, np.int64)
            for i, r in enumerate(rows):
                low[i, : len(r["lows"])], high[i, : len(r["highs"])] = r["lows"], r["highs"]
            yield pa.RecordBatch.from_pylist([block | {"bands": width, "low": low.tobytes(), "high": high.tobytes()}])

    for batch in sliced(batches):
        for row in batch.to_pylist():
            held.append(row)
            size += len(row["v"]) + 1
            if size >= ANCHOR_CELL:
                yield from _cast(out())
                held, size = [], 0
    yield from _cast(out())


def _cast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.set_column(0, "dim", b.column("dim").cast(pa.int32())).set_column(b.schema.get_field_index("bands"), "bands", b.column("bands").cast(pa.int32()))


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first k by score and id, with their rank."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, relabel: bool = True) -> DataFrame:
    """Per anchor and positive the best negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors has vec_id, embedding and label. Components become floor(256 * x), a score is the integer inner product, and
    higher scores come first, ties by smaller vec_id. Anchors are the rows whose vec_id is divisible by `every`; their
    positives are the first rows of their label, and a positive's negatives the first rows of other labels with
    low * positive_score <= 100 * score <= high * positive_score. With relabel, rows whose vec_id is divisible by 7
    take label (label + 1) % 10 first.

    Rows with a null vec_id, label, vector or component, or a component that is not finite, take no part, nor do those
    whose squared norm reaches 2 ** 62. Vectors score with vectors of their own length only. Rows that agree in all three
    columns count once; an anchor is not ranked with rows of its own vec_id, and where rows share a vec_id but not the
    rest, each takes part and the lists of one anchor_id are joined. Extra columns are not read. An empty table, or one
    without anchors, gives an empty result.
    """
    clean = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("v"))
    clean = clean.filter("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").filter(F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))
    if relabel:
        clean = clean.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    clean = stage(clean.distinct(), "vectors")
    size = clean.select(F.sum(F.size("v") + F.lit(1)).alias("all"), F.sum(F.when(F.col("vec_id") % every == 0, F.size("v") + F.lit(1))).alias("anchors")).first()
    groups = max(1, -(-(size["all"] or 0) // ROW_CELL))
    blocks = clean.mapInArrow(_pack, _PACKED).select("*", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int").alias("group"))
    blocks = stage(blocks, "blocks")
    anchors = clean.filter(F.col("vec_id") % every == 0).repartition(max(1, -(-(size["anchors"] or 0) // ANCHOR_CELL)), "vec_id")
    schema = f"{_PACKED}, bands int, low binary, high binary"
    packed = anchors.withColumn("lows", F.array(F.lit(_NONE))).withColumn("highs", F.array(F.lit(np.iinfo(np.int64).max))).mapInArrow(_bands, schema)
    found = _grid(stage(packed, "anchors"), blocks, groups, positives, True)
    best = stage(_first(found.select("anchor_id", "score", "vec_id").distinct(), ["anchor_id"], positives), "positives")
    exactly = F.col("score").cast("decimal(20,0)")
    bounds = best.withColumn("low", F.ceil(exactly * low / 100).cast("long")).withColumn("high", F.floor(exactly * high / 100).cast("long"))
    bounds = bounds.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.array_sort(F.collect_list(F.struct("rank", "low", "high"))).alias("b"))  # at most `positives` each
    banded = anchors.join(bounds, "vec_id").withColumn("lows", F.col("b.low")).withColumn("highs", F.col("b.high")).drop("b")
    banded = banded.repartition(max(1, -(-(size["anchors"] or 0) // ANCHOR_CELL)), "vec_id").mapInArrow(_bands, schema)
    found = _grid(stage(banded, "anchors"), blocks, groups, negatives, False)
    chosen = _first(found.distinct(), ["anchor_id", "band"], negatives)
    named = best.select("anchor_id", (F.col("rank") - 1).cast("long").alias("band"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = named.join(chosen.select("anchor_id", "band", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")), ["anchor_id", "band"])
    out = stage(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
    unstage(clean, blocks, best)
    return out


SQL = """
WITH clean AS (
    SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))
), scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
    FROM clean a JOIN clean b ON a.vec_id % 50 = 0 AND a.vec_id != b.vec_id
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3
"""
