"""Spelling variant grouping (operator 11): edit neighbourhoods guided by Bloom filters.

Words are counted over whole texts. The vocabulary fills blocked Bloom filters, one per word length, which are built by
Spark and broadcast. Every word generates its deletions and its replacements by a greater letter, as hashes made from
prefix sums without building strings; so each pair of near words is generated once, from the longer or the lesser word.
Only edits that a filter knows become rows, which an exact join with the vocabulary then confirms or drops.

The filters of one pass are bounded; a larger vocabulary is cut by hash into several passes, each over all words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, stage, unstage

#: Words of the vocabulary have at least this many code points and occurrences; a form is this many times as frequent.
LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
#: One run in so many loses a letter.
SPOILT = 199
#: Blocks of 256 bits in the filters of one pass (16 MB), and words per block. Longer words than LONG share one filter with
#: a block per word, as they generate many edits.
MOST_BLOCKS, PER_BLOCK, LONG = 1 << 19, 16, 64
#: Words that a task counts before it sends them on, code points read at once, and edits hashed at once.
HELD, PIECE, AT_ONCE = 200_000, 1 << 20, 1 << 20
_LETTERS = "A-Za-zÀ-ÿ"
_RUN, _GAP = re.compile(f"[{_LETTERS}]{{{LEAST_LENGTH},}}"), re.compile(f"[^{_LETTERS}]")
_BASE = 0x9E3779B97F4A7C15
_UNBASE = np.uint64(pow(_BASE, -1, 1 << 64))
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SALTS = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def runs(text: str) -> Iterator[list[str]]:
    """Maximal letter runs of at least LEAST_LENGTH code points, some at a time."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + PIECE) if at + PIECE < len(text) else None
        end = gap.start() if gap else len(text)
        yield _RUN.findall(text, at, end)
        at = end


def words_of(doc_id, text: str | None) -> Counter:
    """Words of one document and how often they occur, with A-Z lower-cased and the runs that lose a letter spoilt."""
    seen, out = Counter(), Counter()
    for found in runs(text or ""):
        seen.update(found)
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in seen.items():
        low = run.encode().lower()  # bytes: A-Z alone change
        h = zlib.crc32(low, start)
        word = low.decode()
        if h % SPOILT == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
            if len(word) < LEAST_LENGTH:
                continue
        out[word] += n
    return out


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of all documents, of the least length and count."""

    def run(batches):
        held: Counter = Counter()
        for batch in sliced(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word, n in words_of(doc_id, text).items():
                    held[word] += n
                if len(held) >= HELD:
                    yield pa.RecordBatch.from_pydict({"word": list(held), "n": list(held.values())})
                    held = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    counted = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


class Filters:
    """Blocked Bloom filters by word length, for the words whose hash falls into one slice of several.

    A block is eight lanes of 32 bits, and a word sets one bit in each lane. `sizes` gives the words of each shard.
    """

    def __init__(self, letters: str, sizes: dict[int, int], piece: int = 0, pieces: int = 1):
        self.letters, self.piece, self.pieces = letters, np.uint64(piece), np.uint64(pieces)
        self.value = _mixed(np.array([ord(c) for c in letters], np.uint64) * np.uint64(_BASE))
        self.start, self.blocks, total = {}, {}, 0
        for shard, words in sorted(sizes.items()):
            self.start[shard], self.blocks[shard] = total, blocks(shard, words, pieces)
            total += self.blocks[shard]
        self.total, self.lanes = total, None

    @staticmethod
    def shard(length: int) -> int:
        return min(length, LONG)

    def by_length(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places in words, their letters' numbers as rows) for each length, a bounded number of words at a time."""
        lengths = np.array([len(w) for w in words], np.int64)
        known = np.zeros(0x100, np.int64)
        known[[ord(c) for c in self.letters]] = np.arange(len(self.letters))
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            step = max(1, AT_ONCE // (int(n) * len(self.letters)))
            for a in range(0, len(at), step):
                part = at[a : a + step]
                yield part, known[np.frombuffer("".join(words[i] for i in part).encode("utf-32-le"), np.uint32).reshape(len(part), n)]

    def sums(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Powers of the base, the letters' terms, and their sums before each place and in all."""
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(codes.shape[1] - 1, _BASE, np.uint64)]))
        terms = self.value[codes] * power
        return power, terms, np.concatenate([np.zeros((len(codes), 1), np.uint64), np.cumsum(terms, axis=1)], axis=1)

    def places(self, h: np.ndarray, shard: int) -> np.ndarray:
        return self.start[shard] + (((h >> np.uint64(32)) * np.uint64(self.blocks[shard])) >> np.uint64(32)).astype(np.int64)

    @staticmethod
    def bit(h: np.ndarray, lane: int) -> np.ndarray:
        return (((h & np.uint64(0xFFFFFFFF)) * _SALTS[lane]) & np.uint64(0xFFFFFFFF)) >> np.uint64(27)

    def here(self, h: np.ndarray) -> np.ndarray:
        """Whether hashes fall into this slice."""
        return (h ^ (h >> np.uint64(31))) % self.pieces == self.piece

    def entries(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(block, its eight lanes) to set for the words of this slice."""
        at, lanes = [np.empty(0, np.int64)], [np.empty((0, 8), np.uint32)]
        for _, codes in self.by_length(words):
            h = _mixed(self.sums(codes)[2][:, -1])
            h = h[self.here(h)]
            at.append(self.places(h, self.shard(codes.shape[1])))
            lanes.append(np.stack([np.uint32(1) << self.bit(h, j).astype(np.uint32) for j in range(8)], 1))
        return np.concatenate(at), np.concatenate(lanes)

    def known(self, h: np.ndarray, shard: int) -> np.ndarray:
        """Indices of hashes (one row) that the shard's filter may hold."""
        if shard not in self.start:
            return np.empty(0, np.int64)
        left = np.flatnonzero(self.here(h)) if self.pieces > 1 else np.arange(len(h))
        h = h[left]
        place = self.places(h, shard)
        for j in range(8):
            ok = (self.lanes[place, j] >> self.bit(h, j).astype(np.uint32) & np.uint32(1)).astype(bool)
            left, h, place = left[ok], h[ok], place[ok]
        return left

    def edits(self, words: list[str]) -> Iterator[tuple[int, str]]:
        """(place in words, edited word) for every deletion and greater replacement that a filter may hold."""
        count = len(self.letters)
        for at, codes in self.by_length(words):
            n = codes.shape[1]
            power, terms, sums = self.sums(codes)
            total = sums[:, -1:]
            if n > LEAST_LENGTH:
                h = sums[:, :-1] + (total - sums[:, 1:]) * _UNBASE
                fresh = np.ones(codes.shape, bool)  # of equal letters in a row, the first goes
                fresh[:, 1:] = codes[:, 1:] != codes[:, :-1]
                row, place = np.nonzero(fresh)
                for k in self.known(_mixed(h[row, place]), self.shard(n - 1)):
                    word = words[at[row[k]]]
                    yield int(at[row[k]]), word[: place[k]] + word[place[k] + 1 :]
            step = max(1, AT_ONCE // (len(codes) * count))  # a word of any length, some of its places at a time
            for a in range(0, n, step):
                own = codes[:, a : a + step]
                row, place, letter = np.nonzero(np.arange(count) > own[:, :, None])
                h = total[row, 0] - terms[row, a + place] + self.value[letter] * power[a + place]
                for k in self.known(_mixed(h), self.shard(n)):
                    word, i = words[at[row[k]]], a + place[k]
                    yield int(at[row[k]]), word[:i] + self.letters[letter[k]] + word[i + 1 :]


def blocks(shard: int, words: int, pieces: int) -> int:
    return -(-words // (pieces * (1 if shard == LONG else PER_BLOCK)))


def _built(filters: Filters, words: DataFrame) -> Filters:
    """The filters with their bits, which Spark has put together; at most as many rows as there are blocks arrive."""

    def run(batches):
        for batch in batches:
            at, lanes = filters.entries(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(lanes[:, j].view(np.int32)) for j in range(8))], names=["at", *(f"l{j}" for j in range(8))])

    rows = words.select("word").mapInArrow(run, "at long, " + ", ".join(f"l{j} int" for j in range(8)))
    found = rows.groupBy("at").agg(*(F.bit_or(f"l{j}").alias(f"l{j}") for j in range(8))).toPandas()
    filters.lanes = np.zeros((filters.total, 8), np.uint32)
    filters.lanes[found["at"].to_numpy(np.int64)] = found[[f"l{j}" for j in range(8)]].to_numpy(np.int32).view(np.uint32)
    return filters


def near_pairs(words: DataFrame, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """(word, n, near, near_n): every pair of words that one inserted, deleted or replaced code point tells apart, once.

    words: a staged table (word, n) with one row per word.
    """
    spark = words.sparkSession
    sizes = {int(r["shard"]): r["k"] for r in words.groupBy(F.least(F.length("word"), F.lit(LONG)).alias("shard")).agg(F.count(F.lit(1)).alias("k")).collect()}  # at most LONG rows
    letters = "".join(sorted(r[0] for r in words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct().filter("c != ''").collect()))  # of the run's letters alone
    whole = sum(blocks(s, k, 1) for s, k in sizes.items())
    pieces = max(1, -(-whole // most_blocks))
    found = None
    for piece in range(pieces):
        shared = spark.sparkContext.broadcast(_built(Filters(letters, sizes, piece, pieces), words)) if letters else None

        def run(batches, shared=shared):
            for batch in sliced(batches, 1 << 18):
                source, n = batch.column(0).to_pylist(), batch.column(1)
                at, near, size = [], [], 0
                for i, edited in shared.value.edits(source):
                    at.append(i)
                    near.append(edited)
                    size += len(edited)
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(near, pa.string()), batch.column(0).take(pa.array(at)), n.take(pa.array(at))], names=["near", "word", "n"])
                        at, near, size = [], [], 0
                if at:
                    yield pa.RecordBatch.from_arrays([pa.array(near, pa.string()), batch.column(0).take(pa.array(at)), n.take(pa.array(at))], names=["near", "word", "n"])

        if shared is None:
            continue
        # Spread the words: a few partitions of them generate a great many edits.
        edits = words.repartition("word").mapInArrow(run, "near string, word string, n long")
        found = edits if found is None else found.unionByName(edits)
    if found is None:
        return words.limit(0).select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n"))
    return found.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "n", "near", "near_n")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): forms followed to the last one, by doubling. Counts grow with each form, so it ends."""
    roots = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        before, roots = roots, stage(roots.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = roots.filter("moved").limit(1).count()
        unstage(before)
        if not moved:
            return roots.select("word", "root")
        roots = roots.select("word", "root")


def spelling_variants(docs: DataFrame, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """Per word of the vocabulary of docs (doc_id, text): word, form, root, n, n_near, form_n.

    Words are letter runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased, at least 6 code points long and found at
    least 5 times; a run whose crc32 with its document is divisible by 199 loses one letter first. Near words differ by
    one code point inserted, deleted or replaced. A word's form is its most frequent near word (ties: the first in
    code-point order) if that is at least five times as frequent; root follows forms to the last. Null and empty texts
    have no words; a null doc_id counts as an empty string in the checksum; repeated rows count again; extra columns are
    not read; an empty table gives an empty result. Runs of any length take part.
    """
    words = stage(vocabulary(docs), "vocabulary")
    pairs = near_pairs(words, most_blocks)
    both = pairs.select(F.explode(F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.first("n").alias("own"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    fits = -F.col("best.less") >= TIMES * F.col("own")
    near = stage(best.select("word", "n_near", F.when(fits, F.col("best.form")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")), "near")
    roots = _roots(near.filter("form IS NOT NULL").select("word", "form"))
    out = words.join(near, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


#: The same in DuckDB: checksums from a table made by rule, near words from deletions joined by place.
SQL = """
WITH RECURSIVE steps AS (
    SELECT v, v AS r, 0 AS k FROM range(256) t(v)
    UNION ALL
    SELECT v, CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, k + 1 FROM steps WHERE k < 8
), crc AS (
    SELECT list(r ORDER BY v) AS t FROM steps WHERE k = 8
), runs AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w
    FROM documents
), counted AS (
    SELECT doc_id, w, count(*) AS n FROM runs WHERE length(w) >= 6 GROUP BY ALL
), summed AS (
    SELECT w, n, xor(4294967295, list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(range(1, 1 + octet_length(encode(coalesce(doc_id::VARCHAR, '') || ':' || w))),
            lambda i: ('0x' || substr(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)), (2 * i - 1)::BIGINT, 2))::BIGINT)),
        lambda a, b: xor(a >> 8, crc.t[1 + (xor(a, b) & 255)]))) AS h
    FROM counted, crc
), spoilt AS (
    SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w) + 2)::BIGINT) ELSE w END AS word, n FROM summed
), words AS (
    SELECT word, sum(n)::BIGINT AS n FROM spoilt WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), cut AS (
    SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
    SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word != b.word
    UNION
    SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
    UNION
    SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
), best AS (
    SELECT word, count(*) AS n_near, min({'l': -near_n, 'w': near}) AS b, any_value(n) AS n FROM near GROUP BY word
), forms AS (
    SELECT word, n_near, CASE WHEN -b.l >= 5 * n THEN b.w END AS form, CASE WHEN -b.l >= 5 * n THEN -b.l END AS form_n FROM best
), walk AS (
    SELECT word, word AS root, 0 AS k FROM words
    UNION ALL
    SELECT walk.word, forms.form, k + 1 FROM walk JOIN forms ON forms.word = walk.root WHERE forms.form IS NOT NULL
), roots AS (
    SELECT word, arg_max(root, k) AS root FROM walk GROUP BY word
)
SELECT words.word, form, root, n, coalesce(n_near, 0)::BIGINT AS n_near, form_n::BIGINT AS form_n
FROM words LEFT JOIN forms USING (word) JOIN roots USING (word)
"""
