"""Lexical retrieval packing (operator 10).

Texts are encoded once and staged as token ids. Documents are then range-partitioned by the least hash of their ids, so
that copies meet, with the id behind it, so that a large group of copies spreads over tasks. Each task takes its documents in shards of a
bounded number of tokens, builds a BM25 inverted index over a shard's token ids, and fills windows: a seed document is
placed, then its best unused neighbours that fit, down its whole ranking by all of its terms, and the best other one is
cut where the window ends. Only a shard's last window can be short; it is cut into sequences of a power of two, which
need no padding.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, stage

WINDOW, END_ID, SHARD_TOKENS = 4096, 2, 2_000_000
K1, B = 1.2, 0.75
#: Neighbours that are ranked at first; the rest of the ranking is sorted only where these leave room.
RANKED = 64
#: Postings that are added up at once.
POSTINGS = 400_000
#: The share of a shard's documents from which on a term counts as common is one in so many.
DENSE = 4
#: The settings of a tokenizer whose ids can be looked up word by word.
_NORMALIZER = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters that are the same in every version of Unicode and are their own normal form, and the split for them alone.
_PLAIN = "\u0250"
_LETTERS = "".join(chr(c) for c in range(128, 0x250) if chr(c).isalpha())
_NUMBERS = "".join(chr(c) for c in range(128, 0x250) if chr(c).isnumeric())
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LETTERS}]+|[0-9{_NUMBERS}]|[^a-z0-9{_LETTERS}{_NUMBERS}]+")
#: str.split() also splits at these four, which the tokenizer keeps.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_WORDS = re.compile("(?:[^\\s]|[\x1c-\x1f])+")
#: Words longer than this are not kept; words that a worker keeps.
LONG, KEPT = 200, 400_000


def word_wise(settings: dict) -> bool:
    """Whether a tokenizer, by its file, drops white space, never joins across it and marks the last token of a part."""
    normalizers = [n["type"] for n in (settings.get("normalizer") or {}).get("normalizers", [])]
    splits = [t.get("pattern", {}).get("Regex") for t in (settings.get("pre_tokenizer") or {}).get("pretokenizers", []) if t["type"] == "Split"]
    spaces = [n.get("content") for n in (settings.get("normalizer") or {}).get("normalizers", []) if n["type"] == "Replace"]
    model = settings["model"]
    return normalizers == _NORMALIZER and spaces == [" "] and splits == [_SPLIT] and model.get("end_of_word_suffix") == "</w>" and not settings.get("post_processor")


def byte_letters() -> list[str]:
    """The letter of each byte in a byte-level alphabet: printable ones stand for themselves, others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + others.index(b)) for b in range(256)]


def lowered(text: str) -> str:
    """The text in lower case, so that fewer words are met, if its ids are surely the same: where all its characters are
    of Latin 1, in which neither composition nor a letter's neighbours matter, and it holds no special string."""
    if "<|" in text:
        return text
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
    return text.lower()


class Known(dict):
    """What `make` gives for strings, kept for those met of late: when `limit` are held they become the old ones, of which
    those met again are kept on."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word) if self.old else None
        if ids is None:
            ids = self.make(word)
        if len(word) <= LONG:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class WordIds:
    """Token ids of texts as little-endian unsigned 32-bit bytes, with an end id behind each.

    If the tokenizer is word-wise, a text's ids are those of its white-space-separated words. The ids of a word of common
    characters are those of its parts in lower case, which go to the tokenizer's merges; another word goes through the
    whole tokenizer. Words and parts are kept, about twice `limit` at most. With any other tokenizer whole texts are
    encoded.
    """

    def __init__(self, file: str, end_id: int = END_ID, limit: int = KEPT):
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(file), Known(self._word, limit)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(file, encoding="utf-8") as f:
            self.fast = word_wise(json.load(f))
        self.end, self.letters = end_id.to_bytes(4, "little"), dict(enumerate(byte_letters()))
        self.merges, self.packed = self.tokenizer.model.tokenize, [struct.Struct(f"<{n}I").pack for n in range(LONG)]

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        ascii_ = word.isascii()
        if not (ascii_ and word.isalpha() and word.islower()):
            if "<|" in word or not (ascii_ or (max(word) < _PLAIN and "\u0130" not in word)):
                return self._whole(word)
            low = word.lower()
            if not low.isalpha():
                parts = _PARTS.findall(low)
                if len(parts) > 1:
                    known = self.known
                    return b"".join([known[p] for p in parts])
            if low != word:
                return self.known[low]
            if not (ascii_ and word.isprintable()):
                word = word.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.merges(word)]
        return self.packed[len(ids)](*ids) if len(ids) < LONG else array("I", ids).tobytes()

    def of(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; a null text has the end id alone."""
        if not self.fast:
            return [self._whole(t) + self.end if t else self.end for t in texts]
        ids = self.known.__getitem__
        split = lambda t: _WORDS.findall(t) if any(c in t for c in _SEPARATORS) else t.split()
        return [b"".join(map(ids, split(lowered(t)))) + self.end if t else self.end for t in texts]


@lru_cache(maxsize=2)
def _words(file: str, end_id: int, limit: int) -> WordIds:
    return WordIds(file, end_id, limit)


_MIX = np.uint32(0x9E3779B1)


def encoded(docs: DataFrame, tokenizer_file: str, end_id: int = END_ID, words_kept: int = KEPT) -> DataFrame:
    """(doc_id, ids, narrow, least) per row of docs: token ids with the end id, in 16 bits where that suffices for a text,
    and the least hash of its ids."""

    def run(batches):
        words = _words(tokenizer_file, end_id, words_kept)
        for batch in sliced(batches):
            raw, narrow, least = words.of(batch.column(1).to_pylist()), [], []
            for i, x in enumerate(raw):
                ids = np.frombuffer(x, "<u4")
                h = ids[:-1] * _MIX
                least.append(int((h ^ (h >> np.uint32(15))).min()) if len(h) else -1)
                narrow.append(bool(ids.max() < 1 << 16))
                if narrow[-1]:
                    raw[i] = ids.astype("<u2").tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), pa.array(narrow), pa.array(least, pa.int64())], names=["doc_id", "ids", "narrow", "least"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary, narrow boolean, least long")


class Index:
    """BM25 over the token ids of one shard. Weights of terms that are in at least a `DENSE`-th of the documents are rows of
    a matrix, which has at most `DENSE` cells for each posting; the others are lists of postings."""

    def __init__(self, ids: list[np.ndarray]):
        n = len(ids)
        lengths = np.array([len(x) for x in ids])
        every = np.concatenate(ids)
        # Keys of 32 bits where a term and a document fit, which sort in half the time.
        shift = max(n - 1, 1).bit_length()
        wide = len(every) and int(every.max()) >> (32 - shift)
        kind = np.uint64 if wide else np.uint32
        keys = np.sort((every.astype(kind) << kind(shift)) | np.repeat(np.arange(n, dtype=kind), lengths))
        new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        tf = np.diff(new, append=len(keys)).astype(np.float64)
        term, self.doc = (keys[new] >> kind(shift)).astype(np.int64), (keys[new] & kind((1 << shift) - 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(term, prepend=-1))
        df = np.diff(first, append=len(term))
        self.start, self.end = first, first + df
        entry = np.repeat(np.arange(len(first)), df)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * lengths / max(lengths.mean(), 1))
        self.weight = idf[entry] * tf * (K1 + 1) / (tf + norm[self.doc])
        by_doc = np.argsort(self.doc, kind="stable")
        self.doc_start = np.searchsorted(self.doc[by_doc], np.arange(n + 1))
        self.terms, self.n = entry[by_doc], n
        # Rows of the matrix for the common terms, whose lists are then empty.
        common = df * DENSE >= n
        self.row = np.where(common, np.cumsum(common) - 1, -1)
        self.column, self.dense = np.arange(n), np.zeros((np.count_nonzero(common), n))
        at = common[entry]
        self.dense[self.row[entry[at]], self.doc[at]] = self.weight[at]
        upto = np.concatenate(([0], np.cumsum(~at)))
        self.start, self.end = upto[self.start], upto[self.end]
        self.doc, self.weight = self.doc[~at], self.weight[~at]

    def scores(self, seed: int, free: np.ndarray) -> np.ndarray:
        """BM25 of every document for all terms of the seed; 0 where a document is not free."""
        own = self.terms[self.doc_start[seed] : self.doc_start[seed + 1]]
        every, scores, rows = self.end[own] - self.start[own], np.zeros(self.n), self.row[own]
        rows, total = rows[rows >= 0], np.zeros(len(self.column))
        for r in rows.tolist():
            total += self.dense[r]
        scores[self.column] = total
        # Terms in runs of about POSTINGS postings, so that memory does not grow with the terms of a long seed.
        runs = np.append(np.searchsorted(np.cumsum(every), np.arange(0, every.sum(), POSTINGS), "right"), len(own))
        for a, b in zip(runs, runs[1:], strict=False):
            counts = every[a:b]
            at = np.repeat(self.start[own[a:b]] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            scores += np.bincount(self.doc[at], self.weight[at], self.n)
        scores[~free] = 0
        return scores

    def drop(self, free: np.ndarray) -> None:
        """Forget the postings of documents that are not free; statistics and terms of seeds stay."""
        keep = free[self.doc]
        upto = np.concatenate(([0], np.cumsum(keep)))
        self.start, self.end = upto[self.start], upto[self.end]
        self.doc, self.weight = self.doc[keep], self.weight[keep]
        keep = free[self.column]
        self.column, self.dense = self.column[keep], self.dense[:, keep]


def ranking(scores: np.ndarray, first: int = RANKED) -> tuple[np.ndarray, np.ndarray]:
    """Documents with a score: the `first` best and those equal to the last of them, best first, and the rest unsorted."""
    found = np.flatnonzero(scores > 0)
    if len(found) <= first:
        return ordered(scores, found), found[:0]
    top = scores[found] >= np.partition(scores[found], len(found) - first)[len(found) - first]
    return ordered(scores, found[top]), found[~top]


def ordered(scores: np.ndarray, docs: np.ndarray) -> np.ndarray:
    return docs[np.lexsort((docs, -scores[docs]))]


def fill(ids: list[np.ndarray], window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (document, start, length), each full but the last."""
    index, free, lengths = Index([x[:-1] for x in ids]), np.ones(len(ids), bool), np.array([len(x) for x in ids])  # the end id is no term
    indexed = len(ids)
    windows, current, room = [], [], window

    def place(d: int) -> None:
        nonlocal current, room
        free[d], at, size = False, 0, len(ids[d])
        while at < size:
            n = min(room, size - at)
            current.append((d, at, n))
            at, room = at + n, room - n
            if not room:
                windows.append(current)
                current, room = [], window

    following = 0
    while True:
        if room == window or not current:  # a new seed: the next document in order
            while following < len(ids) and not free[following]:
                following += 1
            if following == len(ids):
                break
            place(following)
            continue
        if 4 * (left := np.count_nonzero(free)) <= 3 * indexed:
            index.drop(free)
            indexed = left
        scores, cut = index.scores(current[0][0], free), None
        best, rest = ranking(scores)
        while len(best):
            for d in best.tolist():
                if lengths[d] <= room:
                    place(d)
                    if room == window:
                        break
                elif cut is None:
                    cut = d
            if room == window:
                break
            # What is longer than the room can only be the one that is cut.
            best, rest = ordered(scores, rest if cut is None else rest[lengths[rest] <= room]), rest[:0]
        if room == window:
            continue
        if cut is not None:
            place(cut)
            continue
        full = len(windows)
        while len(windows) == full:  # no free document shares a term with the seed
            while following < len(ids) and not free[following]:
                following += 1
            if following == len(ids):
                return [*windows, current]
            place(following)
    return windows + ([current] if current else [])


def powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Pieces of a short window as sequences whose lengths are powers of two."""
    out, todo, left = [], list(reversed(pieces)), sum(n for _, _, n in pieces)
    while left:
        size = 1 << (left.bit_length() - 1)
        left, sequence = left - size, []
        while size:
            d, start, n = todo.pop()
            take = min(n, size)
            sequence.append((d, start, take))
            size -= take
            if take < n:
                todo.append((d, start + take, n - take))
        out.append(sequence)
    return out


_SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer_file: str, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, end_id: int = END_ID, words_kept: int = KEPT) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are its text's, then `end_id`; every id is in one piece. A sequence has `window` ids, or a power of two.
    A null or empty text has the end id alone. Repeated rows are packed each; null ids are kept; extra columns are not read.
    sequence_id is unique over the table, not dense. `window` is a power of two. A worker keeps the ids of up to about twice
    `words_kept` words, 0.2 KB each, whatever the input.
    """

    ids = stage(encoded(docs, tokenizer_file, end_id, words_kept), "token-ids")

    def run(batches):
        task = TaskContext.get()
        sequence = (task.partitionId() if task else 0) << 32
        held, rows, total = [], [], 0

        def flush():
            nonlocal held, rows, total, sequence
            if not held:
                return None
            doc, cols = [], [[] for _ in range(6)]
            windows = fill(held, window)
            if sum(n for _, _, n in windows[-1]) < window:
                windows = windows[:-1] + powers(windows[-1])
            for pieces in windows:
                offset = 0
                for d, start, n in pieces:
                    doc.append(d)
                    for c, v in zip(cols, (start, n, zlib.crc32(held[d][start : start + n].astype("<u4")), len(held[d]), sequence, offset), strict=True):
                        c.append(v)
                    offset += n
                sequence += 1
            source = pa.concat_arrays(rows).take(pa.array(doc, pa.int32()))
            held, rows, total = [], [], 0
            return pa.RecordBatch.from_arrays([source, *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", *(f.split()[0] for f in _SCHEMA.split(", "))])

        for batch in sliced(batches):
            at = 0
            for i, (raw, narrow) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                held.append(np.frombuffer(raw, "<u2" if narrow else "<u4"))
                total += len(held[-1])
                if total >= shard_tokens:
                    rows.append(batch.column(0).slice(at, i + 1 - at))
                    at = i + 1
                    yield flush()
            if at < batch.num_rows:
                rows.append(batch.column(0).slice(at))
        if (last := flush()) is not None:
            yield last

    # Rows that share id and least hash are told apart by their ids, so that a task that is run again packs them alike.
    dealt = ids.withColumn("mark", F.xxhash64("ids")).repartitionByRange("least", "doc_id").sortWithinPartitions("least", "doc_id", "mark")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return dealt.select("doc_id", "ids", "narrow").mapInArrow(run, f"doc_id {kind}, {_SCHEMA}")
