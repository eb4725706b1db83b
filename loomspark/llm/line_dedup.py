"""Line deduplication by range-partitioned hashes (operator 7). DataFrame functions only.

Lines become 128-bit hashes, range-partitioned by hash and document, so that a hash found everywhere spreads over many
tasks, and sorted by document and position within each. One streaming pass gathers a document's positions per hash; a
second, pre-aggregated in each task, gives the hashes of too many documents. What returns to a document is a
run-length-compressed bitmap of its dropped lines, never text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, join_sized, lower_ascii, stage, unstage


def lines_of(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def drop_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, n_dropped, runs): for each document that loses lines, its dropped lines as sorted (start, length) runs.

    A line's key is the line without white space at both ends, A-Z lower-cased. Keys of `min_chars` code points or more
    in `min_docs` documents or more stay in the largest doc_id that holds them, with all their lines there. Rows with a
    null doc_id count for nothing and lose nothing. doc_id is a key: repeated rows of one id are one document, with one
    text. Null and empty texts have one empty line.
    """
    key = lower_ascii(F.btrim("line", F.lit(SPACES)))
    lines = docs.filter("doc_id IS NOT NULL").select("doc_id", F.posexplode(lines_of("text")).alias("pos", "line")).select("doc_id", "pos", key.alias("key")).filter(F.length("key") >= min_chars)
    hashed = lines.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), "doc_id", "pos")
    dealt = hashed.repartitionByRange("h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "pos")
    held = stage(dealt.groupBy("h1", "h2", "doc_id").agg(F.collect_set("pos").alias("at")), "lines")
    many = stage(held.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper")).filter(F.col("n") >= min_docs), "repeated")
    drops = join_sized(held, many, ["h1", "h2"], "n", held.count()).filter("doc_id != keeper").select("doc_id", F.explode("at").alias("pos"))
    island = F.col("pos") - F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    runs = drops.select("doc_id", "pos", island.alias("island")).groupBy("doc_id", "island").agg(F.min("pos").alias("start"), F.count(F.lit(1)).cast("int").alias("length"))
    bitmaps = stage(runs.groupBy("doc_id").agg(F.sum("length").alias("n_dropped"), F.sort_array(F.collect_list(F.struct("start", "length"))).alias("runs")), "bitmaps")
    unstage(held, many)
    return bitmaps


def kept_text() -> tuple[Column, Column]:
    """(lines, text) of columns row, runs and lines: the text without its runs, or the text itself (null as empty) where
    runs is null. What is kept are the slices of lines between runs."""

    def end(j: Column) -> Column:  # of the run before slice j
        r = F.get("runs", j - 1)
        return F.when(j == 0, 0).otherwise(r["start"] + r["length"])

    slices = F.transform(F.sequence(F.lit(0), F.size("runs")), lambda j: F.slice("lines", end(j) + 1, F.coalesce(F.get("runs", j)["start"], F.size("lines")) - end(j)))
    return lines_of("row.text"), F.when(F.col("runs").isNull(), F.coalesce("row.text", F.lit(""))).otherwise(F.array_join(F.flatten(slices), "\n"))


def _kept(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(row, kept, n_lines, n_dropped): every row of docs as a struct, so that no column name can clash."""
    bitmaps = drop_bitmaps(docs, min_chars, min_docs)
    # Hashing the small bitmaps spares a sort of the texts; the plan is the same at every size.
    joined = docs.select(F.struct("*").alias("row")).join(bitmaps.hint("shuffle_hash"), F.col("row.doc_id") == F.col("doc_id"), "left")
    lines, text = kept_text()
    out = joined.select("row", "n_dropped", "runs", lines.alias("lines"))
    return out.select("row", text.alias("kept"), F.size("lines").cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"))


def without_repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs with the kept lines as text. Every row stays, in its columns and types; a null text becomes empty."""
    return _kept(docs, min_chars, min_docs).select(*(F.col("kept").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))


def line_digests(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped and kept_sha256 of the kept lines joined by line feeds."""
    kept = _kept(docs.select("doc_id", "text"), min_chars, min_docs)
    return kept.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH lines AS (
  SELECT doc_id, i, lines[i] AS line, lower_key AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents) d,
       unnest(range(1, len(lines) + 1)) AS u(i),
       LATERAL (SELECT translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_key)
), many AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.*, m.key IS NOT NULL AND l.doc_id != m.keeper AS dropped FROM lines l LEFT JOIN many m USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE dropped))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
