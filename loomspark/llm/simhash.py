"""SimHash near-duplicates by multi-index hashing (operator 12).

A fingerprint of 64 bits has two segments of 32. Fingerprints at 3 differing bits or fewer differ in at most one bit of
one segment. Every distinct fingerprint is filed under both segments' values, and asks for the values at distance one
where its own bit is 0, so that each pair is met from one side. What meets is verified over all 64 bits.

Rows of one segment value arrive in sorted order and are compared block by block; a value's links are returned as the
edges of a forest, never as all pairs. A value filed by more fingerprints than HOT is dealt again by its value and half
of the other segment, with all values at distance one of that half asked for: then 48 bits are fixed, so that no group
exceeds 65,536 fingerprints. Nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_sized, sliced, stage, unstage
from .components import connected_components

#: Words of a shingle, differing bits of a link, seed of the hash.
WORDS, RADIUS, SEED = 3, 3, 42
#: Fingerprints filed under one segment value beyond which the value is dealt again.
HOT = 8192
#: Rows of a group that are compared by shifting a whole batch; cells of a comparison matrix; shingles hashed at once.
FEW, CELLS, PIECE = 32, 1 << 20, 1 << 16


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """A bit is 1 where over half of the shingles' hashes have it; 0 for a text without words. Unsigned."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return 0
    k = min(words, len(found))
    total, ones = len(found) - k + 1, np.zeros(64, np.int64)
    for a in range(0, total, PIECE):
        part = found[a : a + PIECE + k - 1]
        joined = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        starts = [0, *(ends + 1).tolist()]
        h = np.fromiter((xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, ends[k - 1 :].tolist())), np.uint64, len(part) - k + 1)  # noqa: B905
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp) per row of docs; fp is the fingerprint as a signed long."""

    def run(batches):
        for batch in sliced(batches):
            fp = np.fromiter((fingerprint(t, words) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _asked(values: np.ndarray, bits: int, rising: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of all values at distance one, or of those that have one more bit."""
    near = values[:, None] ^ (np.uint64(1) << np.arange(bits, dtype=np.uint64))
    row, bit = np.nonzero(near > values[:, None]) if rising else np.nonzero(np.ones(near.shape, bool))
    return row, near[row, bit]


def filed(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, fp, asks): both segment values of each fingerprint, and the values that it asks for."""
    keys, rows, asks = [], [], []
    for half in (0, 1):
        own = fp >> np.uint64(32 * half) & np.uint64(0xFFFFFFFF)
        row, near = _asked(own, 32, True)
        keys += [own | np.uint64(half << 32), near | np.uint64(half << 32)]
        rows += [fp, fp[row]]
        asks += [np.zeros(len(fp), bool), np.ones(len(row), bool)]
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(asks)


def dealt_again(key: int, fp: np.ndarray, asks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As filed, for the fingerprints that one segment value holds (asks: the value is one they ask for), by that value and
    either half of the other segment."""
    other = fp >> np.uint64(0 if key >> 32 else 32) & np.uint64(0xFFFFFFFF)
    keys, rows, asked = [], [], []
    for half in (0, 1):
        base = np.uint64(key << 17 | half << 16)
        own = other >> np.uint64(16 * half) & np.uint64(0xFFFF)
        up, near_up = _asked(own[~asks], 16, True)
        all_, near_all = _asked(own[asks], 16, False)
        keys += [own | base, near_up | base, near_all | base]
        rows += [fp, fp[~asks][up], fp[asks][all_]]
        asked += [asks, np.ones(len(up), bool), np.ones(len(all_), bool)]
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(asked)


class Group:
    """The fingerprints filed under one value, which of them are linked, and the links of those that ask for it."""

    def __init__(self, members: np.ndarray):
        self.members, self.label = members, np.arange(len(members))
        for _ in self._near(members):
            pass

    def _near(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, links with the members as a matrix) block by block; members linked with one row become one."""
        step = max(1, CELLS // max(len(self.members), 1))
        for a in range(0, len(rows), step):
            part = rows[a : a + step]
            near = np.bitwise_count(part[:, None] ^ self.members) <= RADIUS
            near_any = near.any(1)
            part, near = part[near_any], near[near_any]
            while len(part):
                low = np.where(near, self.label, len(self.label)).min(1)
                bad = low != np.where(near, self.label, -1).max(1)
                if not bad.any():
                    break
                row, member = np.nonzero(near[bad])
                parent = np.arange(len(self.label))
                np.minimum.at(parent, self.label[member], low[bad][row])
                while (parent[parent] != parent).any():
                    parent = parent[parent]
                self.label = parent[self.label]
            yield part, near

    def asked(self, rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """One edge for each row that links with a member."""
        return [(part, self.members[near.argmax(1)]) for part, near in self._near(rows) if len(part)]

    def own(self) -> tuple[np.ndarray, np.ndarray]:
        """The members' forest: each with the first of its component."""
        moved = self.label != np.arange(len(self.label))
        return self.members[moved], self.members[self.label[moved]]


def _few(key: np.ndarray, fp: np.ndarray, asks: np.ndarray, size: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links within small groups of a batch: all rows are compared with the next, the next but one and so on."""
    out, at = [], np.flatnonzero((size > 1) & (size <= FEW))
    for d in range(1, FEW):
        at = at[at + d < len(key)]
        at = at[key[at + d] == key[at]]
        if not len(at):
            break
        link = ~asks[at] & (np.bitwise_count(fp[at] ^ fp[at + d]) <= RADIUS)  # those filed come before those that ask
        out.append((fp[at[link]], fp[at[link] + d]))
    return out


def links(batches: Iterator[pa.RecordBatch], hot: int | None) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) from rows (key, fp, asks) sorted by key and asks; or rows (key, a, asks) for values over `hot`."""
    key_open, members, group, again = None, [], None, False
    edges: list[tuple[np.ndarray, np.ndarray]] = []
    deal: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(fp: np.ndarray, asks: np.ndarray) -> None:
        """More rows of the open value: those filed all come before those that ask."""
        nonlocal members, group, again
        if not again:
            members.append(fp[~asks])
            if hot is not None and sum(map(len, members)) > hot:
                again = True
                filed_now = np.concatenate(members)
                deal.append(dealt_again(key_open, filed_now, np.zeros(len(filed_now), bool)))
                members = []
                fp, asks = fp[asks], asks[asks]
        if again:
            if len(fp):
                deal.append(dealt_again(key_open, fp, asks))
        elif asks.any():
            if group is None:
                group = Group(np.concatenate(members))
            if len(group.members):
                edges.extend(group.asked(fp[asks]))

    def close() -> None:
        nonlocal key_open, members, group, again
        if key_open is not None and not again:
            group = group or Group(np.concatenate(members))
            edges.append(group.own())
        key_open, members, group, again = None, [], None, False

    def out() -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "key", "asks"]
        if edges:
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*edges, strict=True))
            edges.clear()
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.bool_())], names=names)
        if deal:
            key, fp, asks = (np.concatenate(x) for x in zip(*deal, strict=True))
            deal.clear()
            yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.nulls(len(fp), pa.int64()), pa.array(key.view(np.int64)), pa.array(asks)], names=names)

    for batch in batches:
        key, fp, asks = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        fp = fp.view(np.uint64)
        if not len(key):
            continue
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        ends = np.append(starts[1:], len(key))
        for i in {0, len(starts) - 1}:
            if key_open != key[starts[i]]:
                close()
                key_open = int(key[starts[i]])
            add(fp[starts[i] : ends[i]], asks[starts[i] : ends[i]])
        size = np.repeat(ends - starts, ends - starts)
        inner = slice(ends[0], starts[-1])
        if len(starts) > 2:
            edges += _few(key[inner], fp[inner], asks[inner], size[inner])
            for i in np.flatnonzero(ends - starts > FEW):
                if 0 < i < len(starts) - 1:
                    held = key_open, members, group, again
                    key_open, members, group, again = int(key[starts[i]]), [], None, False
                    add(fp[starts[i] : ends[i]], asks[starts[i] : ends[i]])
                    close()
                    key_open, members, group, again = held
        yield from out()
    close()
    yield from out()


def close_fingerprints(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints fp wherever 3 bits or fewer differ."""

    def index(batches):
        for batch in sliced(batches, 1 << 16):
            key, fp, asks = filed(batch.column(0).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(asks)], names=["key", "fp", "asks"])

    def met(rows: DataFrame, most: int | None, name: str) -> DataFrame:
        dealt = rows.repartition("key").sortWithinPartitions("key", "asks")
        return stage(dealt.mapInArrow(lambda batches: links(batches, most), "a long, b long, key long, asks boolean"), name)

    first = met(fps.select("fp").mapInArrow(index, "key long, fp long, asks boolean"), hot, "links")
    edges, again = first.filter("key IS NULL").select("a", "b"), first.filter("key IS NOT NULL")
    if not again.limit(1).count():
        return edges
    second = met(again.select("key", F.col("a").alias("fp"), "asks"), None, "links")
    return edges.unionByName(second.select("a", "b"))


def near_duplicates(docs: DataFrame, words: int = WORDS, hot: int = HOT) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints link at 3 or fewer differing bits; component_id is the smallest doc_id reachable, itself included. Null,
    empty and blank texts have fingerprint zero, which links like any other. A row with a null doc_id has the smallest
    doc_id that its fingerprint reaches, null if there is none. Repeated rows are kept, texts of any length are read
    whole, extra columns are not read, and an empty table gives an empty result.
    """
    own = stage(fingerprints(docs, words), "fingerprints")
    reps = stage(own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("held")), "distinct")
    edges = close_fingerprints(reps, hot)
    parts = connected_components(edges)
    named = stage(reps.join(parts, reps.fp == parts.node, "left").select("fp", "least", "held", F.coalesce("component", "fp").alias("c")), "named")
    of = named.groupBy("c").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members"))
    classes = join_sized(named.select("fp", "held", "c"), stage(of, "components"), "c", "members", reps.count())
    out = join_sized(own, stage(classes.select("fp", "held", "component_id"), "classes"), "fp", "held", own.count())
    unstage(reps, edges, parts, named)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
