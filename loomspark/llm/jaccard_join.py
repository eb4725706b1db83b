"""Exact n-gram Jaccard join with token-combination prefixes (operator 6).

A document's set of word shingles becomes a sorted set of 64-bit hashes. All documents order shingles alike: rare ones
by hash, then common ones, then those beyond a fixed hash bound. If two sets are similar enough to link, the first
n - ceil(t * n) + 1 + m shingles of both share at least 1 + m. Common shingles fall into m classes by hash, so the two
documents share either one rare shingle or two common shingles of one class. Rare shingles are indexed alone and common
ones in pairs; m grows with the prefix, so that the pairs stay in proportion to it.

Equal sets are one class from the start, and index entries with equal documents are one entry. A document's home is the
smallest document that shares an entry with it, or that one's home. Stars compare each document with its home, then with
some more documents of it; documents then known to be connected need no comparison among themselves. What is left of a
home is compared block by block: the documents outside its largest component with all others. So are entries that span
homes. No link between components is lost, and no entry is capped. A pair is refused by an upper bound from two-bit bucket
counts where that suffices; otherwise whole sets decide.

Whether a shingle is common is read from a bitmap of bounded size. A rare shingle that shares its bit with a common one is
common for every document alike, so it costs some more entries and loses nothing.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_sized, sliced, small, stage, unstage
from .components import connected_components

#: Shingles in at least this many documents count as common. Their bitmap has 2 to this power bits at most (32 MB).
COMMON_DOCS, MOST_BITS = 16, 28
#: Documents of a home whose data travels together.
BLOCK = 64
#: Documents of a home or an entry that one comparison takes from each side.
HOME_BLOCK = 256
#: Index entries that a task holds before it sends them on.
HELD = 200_000
#: Share of the hash range, in proportion to the prefix, whose shingles are counted and can be common.
COUNTED = 1.8
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M3
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles, A-Z lower-cased; fewer words than one shingle count as one."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    k = min(words, len(h))
    total = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        total = mixed(total * _M1 + h[i : len(h) - k + 1 + i] * _M2)
    return np.unique(total)


def least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def prefix_base(n: int, percent: int) -> int:
    return n - least_overlap(n, percent) + 1


def classes(n: int, percent: int) -> int:
    """Classes of common shingles for a set of size n: a power of two, about an eighth of its prefix."""
    base = prefix_base(n, percent)
    return 1 if base <= 8 else 1 << (-(-base // 8) - 1).bit_length()


def class_counts(n: int, percent: int) -> set[int]:
    """Of all sizes that can link with n: powers of two between the least and the largest size's."""
    low, high = classes(least_overlap(n, percent), percent), classes(max(n, 100 * n // percent), percent)
    return {low << i for i in range((high // low).bit_length())}


def is_common(tokens: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """bitmap: 64-bit words, a power of two of them."""
    place = tokens & np.uint64(64 * len(bitmap) - 1)
    return (bitmap[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def signatures(tokens: np.ndarray, n: int, percent: int, bitmap: np.ndarray, bound: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """(single, paired): index entries of a set, given its least shingles."""
    often = is_common(tokens, bitmap)
    rank = np.where(tokens >= bound, 2, often)
    order = np.argsort(rank, kind="stable")
    ordered, often = tokens[order], often[order]
    base, singles, pairs = prefix_base(n, percent), np.empty(0, np.uint64), []
    for m in class_counts(n, percent):
        head, flags = ordered[: base + m], often[: base + m]
        if (~flags).sum() > len(singles):
            singles = head[~flags]
        frequent = np.sort(head[flags])
        if len(frequent) > 1:
            kind = frequent & np.uint64(m - 1)
            for c in np.unique(kind):
                own = frequent[kind == c]
                i, j = np.triu_indices(len(own), 1)
                pairs.append(mixed(mixed(own[i] * _M1 + np.uint64(m)) + own[j] * _M2))
    return singles, np.concatenate(pairs) if pairs else np.empty(0, np.uint64)


def sketch(s: np.ndarray) -> tuple[bytes, int]:
    """Counts of a set's hashes in 2 to 4 times as many buckets, two bits each, and what counts over 3 have lost."""
    buckets = 1 << max(6, (2 * len(s) - 1).bit_length())
    counts = np.bincount((s & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
    low = np.minimum(counts, 3).astype(np.uint8).reshape(-1, 4)
    return (low[:, 0] | low[:, 1] << 2 | low[:, 2] << 4 | low[:, 3] << 6).tobytes(), int((counts - np.minimum(counts, 3)).sum())


def _counts(packed: bytes) -> np.ndarray:
    p = np.frombuffer(packed, np.uint8)
    return np.stack([p & 3, p >> 2 & 3, p >> 4 & 3, p >> 6], 1).ravel()


def most_shared(x: np.ndarray, y: np.ndarray) -> int:
    """An upper bound of the sets' overlap from their bucket counts, without what was lost."""
    if len(x) > len(y):
        x, y = y, x
    if len(x) < len(y):
        y = y.reshape(-1, len(x)).sum(0)
    return int(np.minimum(x, y).sum())


def _sets(docs: DataFrame, words: int, percent: int, whole: bool) -> DataFrame:
    """(doc_id, n, set_key, tokens, sketch, lost): tokens are the least shingles; or (doc_id, whole) with sets in bytes."""
    share = min(1.0, COUNTED * (1 - percent / 100))
    bound = np.uint64(int(share * (2**64 - 1)))

    def run(batches):
        for batch in sliced(batches):
            n, keys, out, packed, lost = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text, words)
                n.append(len(s))
                if whole:
                    out.append(s.tobytes())
                    continue
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                bits, over = sketch(s)
                packed.append(bits)
                lost.append(over)
                size = len(s)
                need = prefix_base(size, percent) + max(class_counts(size, percent)) if size else 0
                out.append(s[: max(need, int(np.searchsorted(s, bound)))].view(np.int64).copy())
            if whole:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "whole"])
            else:
                offsets = np.cumsum([0, *map(len, out)])
                flat = np.concatenate(out) if out else np.empty(0, np.int64)
                tokens = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), tokens, pa.array(packed, pa.binary()), pa.array(lost, pa.int32())], names=["doc_id", "n", "set_key", "tokens", "sketch", "lost"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, whole binary" if whole else f"doc_id {kind}, n long, set_key binary, tokens array<long>, sketch binary, lost int"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _bitmap(counts: DataFrame) -> np.ndarray:
    """A bit for each common shingle, at the place of its lowest bits; about one bit in eight is set, more beyond MOST_BITS."""
    often = counts.filter(F.col("df") >= COMMON_DOCS)
    bits = min(MOST_BITS, max(6, (8 * often.count()).bit_length()))
    place = F.col("token").bitwiseAND(F.lit((1 << bits) - 1))
    words = often.select(F.shiftright(place, 6).alias("word"), place.bitwiseAND(F.lit(63)).cast("int").alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("set"))
    out = np.zeros(1 << (bits - 6), np.int64)
    found = words.toPandas()  # at most 2 ** (MOST_BITS - 6) rows
    out[found["word"].to_numpy(np.int64)] = found["set"].to_numpy(np.int64)
    return out.view(np.uint64)


def _index(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Entries (sig, doc, n) that may be shared, and the representatives of equal sets."""
    spark = sets.sparkSession
    counts = sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    counts = stage(counts, "shingle-counts")
    bitmap = spark.sparkContext.broadcast(_bitmap(counts))
    bound = np.uint64(int(min(1.0, COUNTED * (1 - percent / 100)) * (2**64 - 1)))

    def run(batches):
        for batch in batches:
            size = batch.column(1).to_numpy()
            offsets, flat = batch.column(2).offsets.to_numpy(), batch.column(2).values.to_numpy(zero_copy_only=False).view(np.uint64)
            sig, row, paired, held = [], [], [], 0
            for i, n in enumerate(size):
                one, two = signatures(flat[offsets[i] : offsets[i + 1]], int(n), percent, bitmap.value, bound)
                sig += [one, two]
                row.append(np.full(len(one) + len(two), i, np.int32))
                paired += [np.zeros(len(one), bool), np.ones(len(two), bool)]
                held += len(row[-1])
                if held >= HELD or i == len(size) - 1:
                    take = pa.array(np.concatenate(row))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sig).view(np.int64)), pa.array(np.concatenate(paired)), batch.column(0).take(take), batch.column(1).take(take)], names=["sig", "paired", "doc", "n"])
                    sig, row, paired, held = [], [], [], 0

    kind = sets.schema["doc_id"].dataType.simpleString()
    reps = stage(sets.filter("n > 0 AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("held")), "representatives")
    own = sets.select("set_key", "doc_id", "n", "tokens").join(reps.drop("held"), ["set_key", "doc_id"], "left_semi").dropDuplicates(["set_key", "doc_id"])
    entries = own.select("doc_id", "n", "tokens").mapInArrow(run, f"sig long, paired boolean, doc {kind}, n long")
    single = entries.filter("NOT paired").join(counts.select(F.col("token").alias("sig")), "sig", "left_semi")
    every = stage(single.unionByName(entries.filter("paired")).select("sig", "doc", "n"), "index")
    unstage(counts)
    return every, reps


def _compared(pairs: DataFrame, data: DataFrame, test) -> DataFrame:
    """The pairs (key, a, b, ca, cb) for which test(data of a, data of b) holds. data: doc_id and other columns, a row per
    document; ca and cb: the components of a and b, as far as they are known.

    Pairs of one key are compared together, so that data travels once per key and document, not per pair.
    """
    kind = pairs.schema["a"].dataType.simpleString()
    keyed = stage(pairs.select("key", "a", "b", "ca", "cb"), "pairs")
    needed = keyed.select("key", F.col("a").alias("doc_id")).unionByName(keyed.select("key", F.col("b").alias("doc_id"))).distinct()
    sent = needed.join(data, "doc_id").withColumnRenamed("key", "block")

    def run(both: pa.Table, sent: pa.Table) -> pa.Table:
        of = dict(zip(sent.column("doc_id").to_pylist(), sent.drop_columns(["block", "doc_id"]).to_pylist(), strict=True))
        keep = [test(of[a], of[b]) for a, b in zip(both.column("a").to_pylist(), both.column("b").to_pylist(), strict=True)]
        return both.select(["key", "a", "b", "ca", "cb"]).filter(pa.array(keep, pa.bool_()))

    out = stage(keyed.groupBy("key").cogroup(sent.groupBy("block")).applyInArrow(run, f"key long, a {kind}, b {kind}, ca {kind}, cb {kind}"), "compared")
    unstage(keyed)
    return out


def _dealt(members: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """(outsiders, all) of the groups whose members are of several components c, in blocks: members of one key are to be
    compared. Outsiders are those outside a group's largest component. members is a staged table.

    A block holds about HOME_BLOCK members, so that a large group is many keys; if it has few outsiders, it is dealt once.
    """
    by = members.groupBy(group, "c").agg(F.count(F.lit(1)).alias("k")).groupBy(group).agg(F.max(F.struct("k", "c")).alias("most"), F.sum("k").alias("held")).filter("most.k < held")
    rows = join_sized(members, stage(by, "groups"), group, "held", members.count())
    n_out, n_all = (F.ceil(x / HOME_BLOCK) for x in (F.col("held") - F.col("most.k"), F.col("held")))
    columns = [F.col(c) for c in members.columns if c != group] + [(F.col("c") != F.col("most.c")).alias("outside")]
    key = lambda own, other: F.xxhash64(group, own, other).alias("key")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("other")
    mine = lambda n: F.pmod(F.xxhash64("doc_id"), n).alias("own")
    out = rows.filter(F.col("c") != F.col("most.c")).select(group, *columns, mine(n_out), upto(n_all)).select(key("own", "other"), *members.drop(group).columns, "outside")
    every = rows.select(group, *columns, mine(n_all), upto(n_out)).select(key("other", "own"), *members.drop(group).columns, "outside")
    return out, every


def _fold(counts: np.ndarray, buckets: int) -> np.ndarray:
    """Rows of bucket counts over fewer buckets."""
    return counts if counts.shape[1] == buckets else counts.reshape(len(counts), -1, buckets).sum(1, dtype=np.uint16)


def close_pairs(left: list[dict], other: list[dict], percent: int) -> list[tuple]:
    """(a, b, ca, cb), a < b, of documents of different components whose sizes and sketches allow a link: one of each list,
    with their components. Sketches of one length are compared as a matrix."""
    groups: dict[int, list[int]] = {}
    counts = [_counts(d["sketch"]) for d in other]
    for j, c in enumerate(counts):
        groups.setdefault(len(c), []).append(j)
    blocks = {}
    for size, js in groups.items():
        at = np.array(js)
        blocks[size] = (at, np.stack([counts[j] for j in js]), np.array([other[j]["n"] for j in js]), np.array([other[j]["lost"] for j in js]), np.array([other[j]["c"] for j in js], dtype=object))
    folded: dict[tuple[int, int], np.ndarray] = {}
    out = []
    for d in left:
        own = _counts(d["sketch"])
        for size, (at, matrix, n, lost, parts) in blocks.items():
            fits = (100 * np.minimum(n, d["n"]) >= percent * np.maximum(n, d["n"])) & (parts != d["c"])
            if not fits.any():
                continue
            buckets = min(size, len(own))
            if (size, buckets) not in folded:
                folded[size, buckets] = _fold(matrix, buckets)
            mine = _fold(own[None], buckets)[0]
            shared = np.minimum(folded[size, buckets][fits], mine).sum(1, dtype=np.int64) + lost[fits] + d["lost"]
            shared = np.minimum(shared, np.minimum(n[fits], d["n"]))
            ok = 100 * shared >= percent * (n[fits] + d["n"] - shared)
            a, ca = d["doc_id"], d["c"]
            out += [(*x, *y) if (x := (a, ca)) < (y := (other[j]["doc_id"], other[j]["c"])) else (*y, *x) for j in at[fits][ok]]
    return [(a, b, ca, cb) for a, ca, b, cb in out]


class Verifier:
    """Decides candidate pairs: by bounds from sketches first, then, for what is left, by whole sets made from the texts."""

    def __init__(self, docs: DataFrame, sets: DataFrame, homes: DataFrame, words: int, percent: int):
        self.docs, self.words, self.percent = docs, words, percent
        h = homes.select(F.col("doc").alias("doc_id"), "home", "size")
        self.sketches = stage(sets.select("doc_id", "n", "sketch", "lost").join(h, "doc_id").dropDuplicates(["doc_id"]), "sketches")

    def links(self, pairs: DataFrame, stars: bool = False) -> DataFrame:
        percent = self.percent

        def may(x: dict, y: dict) -> bool:
            shared = min(most_shared(_counts(x["sketch"]), _counts(y["sketch"])) + x["lost"] + y["lost"], x["n"], y["n"])
            return 100 * shared >= percent * (x["n"] + y["n"] - shared)

        return self.verified(_compared(pairs, self.sketches.select("doc_id", "n", "sketch", "lost"), may), stars)

    def verified(self, close: DataFrame, stars: bool = False) -> DataFrame:
        """Of pairs that sketches allow those whose whole sets link."""
        percent = self.percent

        def do(x: dict, y: dict) -> bool:
            x, y = np.frombuffer(x["whole"], np.uint64), np.frombuffer(y["whole"], np.uint64)
            shared = len(np.intersect1d(x, y, assume_unique=True))
            return 100 * shared >= percent * (len(x) + len(y) - shared)

        if not close.limit(1).count():
            return _edges(close)
        ids = stage(close.select(F.col("a").alias("doc_id")).union(close.select("b")).distinct(), "close")
        texts = self.docs.select("doc_id", "text").join(small(ids), "doc_id", "left_semi")
        whole = stage(_sets(texts, self.words, percent, True).dropDuplicates(["doc_id"]), "whole-sets")
        out = (_star_edges if stars else _edges)(_compared(close, whole, do))
        unstage(ids, whole)
        return out

    def named(self, parts: DataFrame) -> DataFrame:
        """Sketches of documents that share a home with others, with their component c."""
        named = self.sketches.filter("size > 1").join(parts, F.col("doc_id") == F.col("node"), "left")
        return stage(named.withColumn("c", F.coalesce("component", "doc_id")).drop("node", "component"), "named")

    def more_stars(self, parts: DataFrame) -> DataFrame:
        """Pairs of a document and one of up to eight others of its home that are of another component."""
        named = self.named(parts)
        pivots = named.groupBy("home", F.pmod(F.xxhash64("doc_id"), F.lit(8)).alias("star")).agg(F.min(F.struct("doc_id", "n", "c")).alias("p"), F.first("size").alias("held"))
        pivots = pivots.filter("p.doc_id != home").groupBy("home").agg(F.collect_list("p").alias("pivots"), F.first("held").alias("held"))  # at most eight
        pairs = join_sized(named.select("home", "size", "doc_id", "n", "c"), stage(pivots, "pivots"), "home", "held", named.count())
        pairs = pairs.select("home", "size", "doc_id", "n", "c", F.explode("pivots").alias("p")).filter((F.col("c") != F.col("p.c")) & _close(self.percent, "n", "p.n"))
        return pairs.select(_block_key("home", "doc_id"), F.col("p.doc_id").alias("a"), F.col("doc_id").alias("b"), F.col("p.c").alias("ca"), F.col("c").alias("cb"))

    def within_homes(self, parts: DataFrame) -> DataFrame:
        """Close pairs of one home and different components, block by block."""
        percent, kind = self.percent, self.sketches.schema["doc_id"].dataType.simpleString()
        out, every = _dealt(self.named(parts).drop("size"), "home")
        role = lambda df, left: df.select("key", "doc_id", "n", "sketch", "lost", "c", F.lit(left).alias("is_left"))

        def run(table: pa.Table) -> pa.Table:
            rows = table.to_pylist()
            found = set(close_pairs([r for r in rows if r["is_left"]], [r for r in rows if not r["is_left"]], percent))
            columns = list(zip(*sorted(found), strict=True)) if found else [()] * 4
            of = lambda x: pa.array(x, table.column("doc_id").type)
            return pa.table({"key": pa.array([rows[0]["key"]] * len(columns[0]), pa.int64()), **dict(zip(("a", "b", "ca", "cb"), map(of, columns), strict=True))})

        return role(out, True).unionByName(role(every, False)).groupBy("key").applyInArrow(run, f"key long, a {kind}, b {kind}, ca {kind}, cb {kind}")


def _edges(linked: DataFrame) -> DataFrame:
    """(a, b): the components that linked pairs join. One edge says it, however many links do."""
    pairs = linked.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"))
    return stage(pairs.distinct(), "edges")


def _star_edges(linked: DataFrame) -> DataFrame:
    """As _edges, of pairs (pivot a, document b) with at most eight pivots per document: a document is joined to the least
    of its pivots' components, and the others to that one, so that few edges differ between the documents of a home."""
    near = linked.groupBy("b", "cb").agg(F.array_sort(F.collect_set("ca")).alias("all"))
    first = F.col("all")[0]
    own = near.select(first.alias("a"), F.col("cb").alias("b"))
    others = near.select(first.alias("a"), F.explode(F.slice("all", 2, F.size("all"))).alias("b"))
    return stage(own.unionByName(others).distinct(), "edges")


def _block_key(home: str, doc: str):
    """Documents of one home travel in blocks of about BLOCK documents; its size is in column size."""
    return F.xxhash64(home, F.pmod(F.xxhash64(doc), F.ceil(F.col("size") / BLOCK))).alias("key")


def _close(percent: int, x: str, y: str):
    """Sizes that can link."""
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _homes(entries: DataFrame) -> DataFrame:
    """(doc, home, size): the smallest document of a shared entry, or rather its home's home, and how many documents it has."""
    homes = stage(entries.groupBy("doc").agg(F.min("pivot").alias("home")), "homes")
    held = stage(homes.groupBy("home").agg(F.count(F.lit(1)).alias("held")), "homes")
    up = stage(held.join(homes.select(F.col("doc").alias("home"), F.col("home").alias("up")), "home"), "homes")
    up = stage(up.join(up.select(F.col("home").alias("up"), F.col("up").alias("root")), "up").select("home", "held", "root"), "homes")
    sizes = up.groupBy("root").agg(F.sum("held").alias("size"))
    found = join_sized(homes, stage(up.join(sizes, "root"), "homes"), "home", "held", homes.count())
    return stage(found.select("doc", F.col("root").alias("home"), "size"), "homes")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included).

    Two documents link when 100 * shared shingles >= percent * all shingles of both. Null, empty and blank texts have
    no shingles and link with nothing, nor do rows with a null doc_id, whose component is null. Repeated rows are kept.
    Extra columns of docs are not read. An empty table gives an empty result.
    """
    sets = stage(_sets(docs, words, percent, False), "sets")
    every, reps = _index(sets, percent)
    # Entries with the same documents say the same: one of them is kept.
    shared = every.groupBy("sig").agg(F.count(F.lit(1)).alias("k"), F.min("doc").alias("pivot"), F.sum(F.xxhash64("doc").cast("decimal(20,0)")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "doc")).alias("h2")).filter("k > 1")
    shared = shared.groupBy("k", "h1", "h2").agg(F.min(F.struct("sig", "pivot")).alias("s")).select("s.sig", "s.pivot", "k")
    shared = stage(shared, "entries")
    entries = stage(join_sized(every, shared, "sig", "k", every.count()), "index")
    unstage(every, shared)
    homes = _homes(entries)
    verifier = Verifier(docs, sets, homes, words, percent)
    # Stars: every document and its home. What they connect needs no comparison among itself.
    links = verifier.links(homes.filter("doc != home").select(_block_key("home", "doc"), F.col("home").alias("a"), F.col("doc").alias("b"), F.col("home").alias("ca"), F.col("doc").alias("cb")))
    links = links.unionByName(verifier.links(verifier.more_stars(connected_components(links)), stars=True))
    links = links.unionByName(verifier.verified(stage(verifier.within_homes(connected_components(links)), "close")))
    parts = connected_components(links)
    # Pairs that share an entry but no home.
    named = entries.select("sig", F.col("doc").alias("doc_id"), "n").join(homes.select(F.col("doc").alias("doc_id"), "home", _block_key("home", "doc").alias("at")), "doc_id")
    named = stage(named.join(parts, F.col("doc_id") == F.col("node"), "left").select("sig", "doc_id", "n", "home", "at", F.coalesce("component", "doc_id").alias("c")), "named")
    x, y = (side.select("key", *(F.col(c).alias(c + name) for c in ("doc_id", "n", "home", "at", "c", "outside"))) for side, name in zip(_dealt(named, "sig"), "xy", strict=True))
    pairs = x.join(y, "key").filter((F.col("homex") != F.col("homey")) & (F.col("cx") != F.col("cy")) & _close(percent, "nx", "ny") & (~F.col("outsidey") | (F.col("doc_idx") < F.col("doc_idy"))))
    x, y = F.struct(F.col("doc_idx").alias("doc_id"), F.col("cx").alias("c")), F.struct(F.col("doc_idy").alias("doc_id"), F.col("cy").alias("c"))
    pairs = pairs.select(F.xxhash64(F.least("atx", "aty"), F.greatest("atx", "aty")).alias("key"), F.least(x, y).alias("x"), F.greatest(x, y).alias("y")).distinct()
    pairs = pairs.select("key", F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"), F.col("x.c").alias("ca"), F.col("y.c").alias("cb"))
    links = links.unionByName(verifier.links(pairs))
    parts = connected_components(links)
    unstage(entries, homes, verifier.sketches)
    classes = stage(reps.join(parts, reps.doc_id == parts.node, "left").select("set_key", "held", F.coalesce("component", "doc_id").alias("component_id")), "classes")
    own = (F.col("n") == 0) | F.col("doc_id").isNull()
    of_set = join_sized(sets.filter(~own).select("doc_id", "n", "set_key"), classes, "set_key", "held", sets.count())
    alone = sets.filter(own).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return of_set.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone)


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document, the smallest doc_id, of each group of near-duplicates. Rows without an id or words stay."""
    found = near_duplicates(docs, words, percent)
    gone = stage(found.filter("component_id != doc_id").select("doc_id").distinct(), "duplicates")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
