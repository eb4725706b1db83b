"""Benchmark decontamination by pigeonhole edit matching (operator 3).

A test item of m characters may appear with up to k = rate * m edits. Cut into k + 1 pieces, at least one piece appears
unchanged, so exact piece hits find every candidate place; Myers' bit-parallel algorithm then gives the distance there.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, stage

#: Characters of test items searched for at once; more items are taken in blocks of about this size.
BLOCK_CHARS = 4_000_000


def normalized(text: str | None) -> str:
    """Lower case, white space runs as one space."""
    return " ".join(text.lower().split()) if text else ""


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 pieces of near-equal length with their offsets."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def masks(item: str) -> dict[str, int]:
    found: dict[str, int] = {}
    for i, c in enumerate(item):
        found[c] = found.get(c, 0) | 1 << i
    return found


def best_distance(item_masks: dict[str, int], m: int, text: str) -> int:
    """The least edit distance between the item and any substring of text, by Myers' bit vectors."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for c in text:
        eq = item_masks.get(c, 0)
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best = score
        ph = ph << 1 & full
        xv = eq | mv
        pv = (mh << 1 & full) | (full & ~(xv | ph))
        mv = ph & xv
    return best


class Matcher:
    """Finds a block of items in texts."""

    def __init__(self, items: list[tuple], rate: float):
        import ahocorasick

        self.ids, self.texts = [i for i, _ in items], [t for _, t in items]
        self.budgets = [int(rate * len(t)) for t in self.texts]
        self.masks = [masks(t) for t in self.texts]
        at: dict[str, list[tuple[int, int]]] = {}
        for n, t in enumerate(self.texts):
            for offset, piece in pieces(t, self.budgets[n]):
                at.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in at.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple]:
        """(item id, distance, places searched) of each item within its budget."""
        starts: dict[int, set[int]] = {}
        for end, (length, places) in self.automaton.iter(text):
            for n, offset in places:
                starts.setdefault(n, set()).add(end + 1 - length - offset)
        found = []
        for n, places in starts.items():
            m, k = len(self.texts[n]), self.budgets[n]
            best, regions = m, []
            for s in sorted(places):
                a, b = max(0, s - k), s + m + k
                if regions and a <= regions[-1][1]:
                    regions[-1][1] = max(b, regions[-1][1])
                else:
                    regions.append([a, b])
            for a, b in regions:
                if b > 0 and best > 0:
                    best = 0 if self.texts[n] in text[a:b] else min(best, best_distance(self.masks[n], m, text[a:b]))
            if best <= k:
                found.append((self.ids[n], best, len(regions)))
        return found


def blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS):
    """The items in blocks of bounded size, each a list of (item_id, normalized text). Only one block is in memory."""
    total = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = int(total // block_chars) + 1
    for p in range(parts):
        rows = benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p) if parts > 1 else benchmark
        yield [(r.item_id, t) for r in rows.select("item_id", "text").distinct().collect() if (t := normalized(r.text))]


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, n_places): each document and test item found in it within rate * length edits.

    Both are compared in lower case with white space runs as one space; every document's whole text is searched for
    every item. Null or blank texts and items match nothing; repeated documents or items give repeated rows only for
    repeated documents; an empty benchmark gives an empty result. Null ids are kept as they are.
    """
    doc_type, item_type = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {doc_type}, item_id {item_type}, distance int, n_places int"
    spark, out = docs.sparkSession, None
    for block in blocks(benchmark, block_chars):
        sent = spark.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            matcher = Matcher(sent.value, rate) if sent.value else None
            for batch in sliced(batches):
                ids, rows = [], []
                if matcher:
                    for i, text in enumerate(batch.column(1).to_pylist()):
                        hits = matcher.find(normalized(text)) if text else []
                        ids += [i] * len(hits)
                        rows += hits
                item, distance, places = zip(*rows, strict=True) if rows else ([], [], [])
                names = ["doc_id", "item_id", "distance", "n_places"]
                kind = pa.string() if item_type == "string" else pa.int32() if item_type == "int" else pa.int64()
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int32())), pa.array(item, kind), pa.array(distance, pa.int32()), pa.array(places, pa.int32())], names=names)

        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08) -> DataFrame:
    """docs without those that hold a test item. Documents with a null id stay unless their own text holds one.

    Rows that share an id go if any of them holds an item. All columns are kept, whatever their names.
    """
    # Rows with a null id are told apart by their text, which alone decides whether they hold an item.
    key = F.when(F.col("doc_id").isNull(), F.concat(F.lit("text "), F.sha2("text", 256))).otherwise(F.concat(F.lit("id "), F.col("doc_id").cast("string")))
    hits = stage(contaminated(docs.select(key.alias("doc_id"), "text"), benchmark, rate).select(F.col("doc_id").alias("key")).distinct(), "contaminated")
    return docs.select(F.struct("*").alias("row"), key.alias("key")).join(hits, "key", "left_anti").select("row.*")
