"""Similarity search, retention and usage of stored vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.arrays import doubles
from ..functions.ordered import in_order, walk

#: Queries of a block.
QUERY_BLOCK = 2_000


#: Vectors of a block of queries and of keys.
KEY_BLOCK = 4_000


def _blocks(df: DataFrame, id_col: str, vector: str, rows: int, name: str) -> tuple[DataFrame, int]:
    """(id, v, name) with name the row's block, of `rows` rows on average, and how many blocks there are."""
    slim = df.filter(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), doubles(vector).alias("v"))
    parts = max(1, -(-slim.count() // rows))
    return slim.withColumn(name, F.pmod(F.xxhash64("id", "v"), F.lit(parts)).cast("int")), parts


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64)


def knn(queries: DataFrame, keys: DataFrame, k: int, metric: str = "cosine", query_id: str = "query_id", key_id: str = "key_id", vector: str = "vector", block: int = QUERY_BLOCK, key_block: int = KEY_BLOCK) -> DataFrame:
    """(query_id, key_id, score, rank): each query's k best keys, higher is better, ties by key_id.

    The stated query set meets all keys on a grid: blocks of queries and blocks of keys, both shuffled, one matrix product
    per cell that keeps a partial top k, and a final top k per query. Keys are read once, and nothing goes through the
    driver. Null vectors match nothing; fewer keys than k give what there is.
    """
    if metric not in ("cosine", "dot", "l2"):
        raise ValueError(f"unknown metric {metric}")
    q, rows = _blocks(queries, query_id, vector, block, "qb")
    x, columns = _blocks(keys, key_id, vector, key_block, "kb")
    qt, kt = queries.schema[query_id].dataType.simpleString(), keys.schema[key_id].dataType.simpleString()
    to = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q, x = q.withColumn("kb", to(columns)), x.withColumn("qb", to(rows))

    def best(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = {query_id: asked.column("id").slice(0, 0), key_id: held.column("id").slice(0, 0), "score": pa.array([], pa.float64())}
        if asked.num_rows and held.num_rows:
            held = held.take(pa.compute.sort_indices(held, sort_keys=[("id", "ascending")]))
            m, c = _matrix(asked.column("v")), _matrix(held.column("v"))
            if metric == "cosine":
                m, c = (a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12) for a in (m, c))
            s = m @ c.T if metric != "l2" else -((m * m).sum(1)[:, None] - 2 * m @ c.T + (c * c).sum(1)[None])
            at = np.argsort(-np.round(s, 12), axis=1, kind="stable")[:, :k]  # keys are in order of their ids
            out = {query_id: asked.column("id").take(np.repeat(np.arange(len(s)), at.shape[1])), key_id: held.column("id").take(at.ravel()), "score": np.take_along_axis(s, at, 1).ravel()}
        return pa.table(out)

    part = q.groupBy("qb", "kb").cogroup(x.groupBy("qb", "kb")).applyInArrow(best, f"`{query_id}` {qt}, `{key_id}` {kt}, score double")
    return part.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy(F.round("score", 12).desc(), key_id))).filter(F.col("rank") <= k)


def cells(vectors: np.ndarray, pivots: int) -> list[np.ndarray]:
    """Rows of each cell: every row is with the nearest of some rows that lie far apart (farthest-first)."""
    chosen, far = [0], ((vectors - vectors[0]) ** 2).sum(1)
    of = np.zeros(len(vectors), np.int64)
    while len(chosen) < min(pivots, len(vectors)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        d = ((vectors - vectors[chosen[-1]]) ** 2).sum(1)
        of, far = np.where(d < far, len(chosen) - 1, of), np.minimum(d, far)
    return [np.flatnonzero(of == c) for c in range(len(chosen))]


def nearest_rows(a: np.ndarray, c: np.ndarray, k: int, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of c, squared distance to nine digits) of each row's k nearest, ties by the row of c.

    Both sides are cut into cells around pivots. Of two cells with pivots D apart and radii r and s no rows are nearer than
    D - r - s; cells are visited by that bound, and no more once it exceeds every row's k-th distance. counts: receives
    the pairs there are and the pairs compared.
    """
    mine, other = (cells(x, int(np.sqrt(len(x))) + 1) for x in (a, c))
    centre = lambda x, cell: x[cell].mean(0)
    pivots = np.stack([centre(c, cell) for cell in other])
    radius = np.array([np.sqrt(((c[cell] - p) ** 2).sum(1).max()) for cell, p in zip(other, pivots, strict=True)])
    rows, cols, dist = [], [], []
    for cell in mine:
        p = centre(a, cell)
        bound = np.maximum(np.sqrt(((pivots - p) ** 2).sum(1)) - radius - np.sqrt(((a[cell] - p) ** 2).sum(1).max()), 0)
        best_d, best_at = np.full((len(cell), 0), 0.0), np.zeros((len(cell), 0), np.int64)
        for o in np.argsort(bound, kind="stable"):
            if best_d.shape[1] >= k and bound[o] ** 2 > best_d[:, k - 1].max() + 1e-6 * (1 + best_d[:, k - 1].max()):
                break
            x = c[other[o]]
            d = np.round(np.maximum((a[cell] ** 2).sum(1)[:, None] - 2 * a[cell] @ x.T + (x * x).sum(1)[None], 0), 9)
            d, at = np.concatenate([best_d, d], 1), np.concatenate([best_at, np.broadcast_to(other[o], d.shape)], 1)
            order = np.lexsort((at, d), axis=1)[:, :k]
            best_d, best_at = np.take_along_axis(d, order, 1), np.take_along_axis(at, order, 1)
            if counts is not None:
                counts[1] += len(cell) * len(x)
        rows.append(np.repeat(cell, best_at.shape[1]))
        cols.append(best_at.ravel())
        dist.append(best_d.ravel())
    if counts is not None:
        counts[0] += len(a) * len(c)
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(dist)


#: Nodes of a group in one block.
GRAPH_BLOCK = 4_000


def knn_graph(nodes: DataFrame, k: int, group: str, node: str, vector: str) -> DataFrame:
    """(group, src, dst, distance, rank): each node's k nearest of its group by squared distance, itself included.

    Nodes of a group are cut into blocks by hash; every pair of blocks is one task's work, which visits pairs of cells by
    the least distance they allow and keeps a partial top k; the final top k per node is a shuffle of blocks x nodes x k
    rows. Null vectors and null groups match nothing.
    """
    gt, nt = nodes.schema[group].dataType.simpleString(), nodes.schema[node].dataType.simpleString()
    slim = nodes.select(F.col(group).alias("g"), F.col(node).alias("n"), doubles(vector).alias("v")).filter("g IS NOT NULL AND v IS NOT NULL")
    sizes = slim.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / F.lit(GRAPH_BLOCK)).alias("parts"))
    b = slim.join(sizes, "g").withColumn("b", F.pmod(F.xxhash64("n"), F.col("parts")))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    asked = b.select("g", F.col("b").alias("qb"), every.alias("kb"), "n", "v", F.lit(True).alias("asks"))
    held = b.select("g", every.alias("qb"), F.col("b").alias("kb"), "n", "v", F.lit(False).alias("asks"))

    def nearest(table: pa.Table) -> pa.Table:
        q, x = table.filter(table.column("asks")), table.filter(pa.compute.invert(table.column("asks")))
        out = {"g": q.column("g").slice(0, 0), "src": q.column("n").slice(0, 0), "dst": x.column("n").slice(0, 0), "distance": pa.array([], pa.float64())}
        if q.num_rows and x.num_rows:
            x = x.take(pa.compute.sort_indices(x, sort_keys=[("n", "ascending")]))
            row, at, d = nearest_rows(_matrix(q.column("v")), _matrix(x.column("v")), k)
            out = {"g": q.column("g").take(row), "src": q.column("n").take(row), "dst": x.column("n").take(at), "distance": d}
        return pa.table(out)

    part = asked.unionByName(held).groupBy("g", "qb", "kb").applyInArrow(nearest, f"g {gt}, src {nt}, dst {nt}, distance double")
    ranked = part.withColumn("rank", F.row_number().over(Window.partitionBy("g", "src").orderBy("distance", "dst"))).filter(F.col("rank") <= k)
    return ranked.withColumnRenamed("g", group)


def retain(entries: DataFrame, capacity: int, bank: str, slot: str, order: list[str]) -> DataFrame:
    """The `capacity` last slots of each bank by `order`, a slot counting at its last entry. FIFO: entries are writes;
    LRU: writes and retrievals."""
    last = entries.groupBy(bank, slot).agg(F.max(F.struct(*order)).alias("last"))
    ranked = last.withColumn("r", F.row_number().over(Window.partitionBy(bank).orderBy(F.col("last").desc(), F.col(slot).desc())))
    return ranked.filter(F.col("r") <= capacity).select(bank, slot, "last.*")


def retain_lfu(log: DataFrame, capacity: int, bank: str, slot: str, order: str, kind: str) -> DataFrame:
    """Least frequently used, exact: (bank, slot, uses) held at the end. kind is write or read. A write to a full bank
    evicts the slot with the fewest reads, the oldest of them. State depends on order, so a bank is one pass in Arrow
    batches, and a task holds `capacity` slots."""
    bt, st = log.schema[bank].dataType.simpleString(), log.schema[slot].dataType.simpleString()

    class Held(dict):
        def step(self, s, action):
            if action == "read":
                if s in self:
                    self[s] += 1
            elif s not in self:
                if len(self) >= capacity:
                    del self[min(self, key=self.get)]
                self[s] = 0
            return ()

        def end(self):
            return self.items()

    slots = to_arrow_type(log.schema[slot].dataType)
    dealt = in_order(log.select(bank, slot, kind, order), bank, [F.col(order).asc_nulls_last()]).select(bank, slot, kind)
    return dealt.mapInArrow(walk(Held, [bank, slot, "uses"], [slots, pa.int64()]), f"`{bank}` {bt}, `{slot}` {st}, uses long")


def since_clear(log: DataFrame, bank: str, order: str, kind: str, clear: str = "clear") -> DataFrame:
    """The log without what a later `clear` of its bank has emptied, and without the clears."""
    last = log.filter(F.col(kind) == clear).groupBy(F.col(bank).alias("_bank")).agg(F.max(order).alias("_cleared"))
    rows = log.filter(F.col(kind) != clear).join(last, F.col(bank).eqNullSafe(F.col("_bank")), "left")
    return rows.filter(F.col("_cleared").isNull() | (F.col(order) > F.col("_cleared"))).select(log.columns)


def usage(retrievals: DataFrame, slot: str) -> DataFrame:
    return retrievals.groupBy(slot).agg(F.count(F.lit(1)).alias("uses"))
