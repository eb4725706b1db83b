import hashlib
import random

from loomspark.llm.line_dedup import drop_bitmaps, line_digests, without_repeated_lines


def brute(rows, min_chars=20, min_docs=3):
    key = lambda line: "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(i)
    out = {}
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < min_docs or i == max(holders[key(x)])]
        out[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def test_equals_brute_force(spark):
    rng = random.Random(4)
    lines = [f"A line that is quite long, number {i} é" for i in range(12)] + ["short", "", "  \t", "Exactly twenty chars", "nineteen characters", "\x0bPadded line of some length \r"]
    rows = []
    for i in range(120):
        own = [rng.choice(lines) if rng.random() < 0.7 else f"own line {rng.random()}" for _ in range(rng.randrange(0, 14))]
        rows.append((i * 7 % 1000, "\n".join(x.upper() if rng.random() < 0.2 else f" {x}" if rng.random() < 0.2 else x for x in own) if i % 11 else None))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_digests(docs).collect()}
    assert got == brute(rows)
    runs = {r.doc_id: r.runs for r in drop_bitmaps(docs).collect()}
    assert {i: n for i, (_, n, _) in got.items() if n} == {i: sum(x.length for x in r) for i, r in runs.items()}


def test_odd_rows(spark, odd_docs):
    clash = odd_docs.selectExpr("*", "'mine' AS _n_lines", "'too' AS n_dropped", "1 AS runs", "2 AS row", "3 AS h1")
    out = without_repeated_lines(clash, min_docs=1)
    assert out.count() == 8 and out.columns == clash.columns and {r._n_lines + r.n_dropped for r in out.collect()} == {"minetoo"}
    kept = {(r.doc_id, r.n_lines, r.n_dropped) for r in line_digests(clash, min_docs=1).collect()}
    assert kept == {(1, 1, 0), (2, 1, 0), (3, 2, 0), (4, 1, 0), (5, 1, 0), (None, 1, 0), (7, 1, 0)}
    assert line_digests(odd_docs.limit(0)).count() == 0


def test_a_line_of_all_documents_is_joined_from_a_broadcast(spark, monkeypatch):
    from loomspark.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 20)
    rows = [(i, f"The line that every document holds.\nOwn line of number {i}, long enough\n{'Another line, held by a few of them' if i % 50 == 0 else ''}") for i in range(300)]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
