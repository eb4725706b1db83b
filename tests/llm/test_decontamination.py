import random

from loomspark.llm.decontamination import best_distance, contaminated, decontaminate, masks, normalized, pieces


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_bit_vectors_equal_the_table():
    rng = random.Random(8)
    for _ in range(300):
        pattern = "".join(rng.choices("abcé", k=rng.randint(1, 90)))
        text = "".join(rng.choices("abcé", k=rng.randint(0, 120)))
        assert best_distance(masks(pattern), len(pattern), text) == distance(pattern, text)
    assert "".join(p for _, p in pieces("abcdefghij", 3)) == "abcdefghij" and len(pieces("abcdefghij", 3)) == 4


def corpus(spark):
    rng = random.Random(2)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n))
    items = [(i, words(25)) for i in range(12)]
    rows = []
    for i in range(80):
        text = words(60)
        if i % 2:
            passage = list(items[i % 12][1])
            for _ in range(rng.randint(0, 14)):
                at = rng.randrange(len(passage))
                passage[at : at + rng.randint(0, 1)] = rng.choice("xyz ")
            text = f"{text} {''.join(passage).upper() if i % 3 else ''.join(passage)}\n{words(20)}"
        rows.append((i, text))
    return rows, items


def test_finds_what_brute_force_finds(spark):
    rows, items = corpus(spark)
    got = contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = set()
    for i, text in rows:
        for j, item in items:
            d = distance(normalized(item), normalized(text))
            if d <= int(0.08 * len(normalized(item))):
                want.add((i, j, d))
    assert {(r.doc_id, r.item_id, r.distance) for r in got} == want and want


def test_blocks_give_the_same(spark):
    rows, items = corpus(spark)
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    key = lambda df: sorted((r.doc_id, r.item_id, r.distance) for r in df.collect())
    assert key(contaminated(docs, benchmark)) == key(contaminated(docs, benchmark, block_chars=500))


def test_odd_rows(spark, odd_docs):
    items = spark.createDataFrame([(1, "the same text twice in this table"), (2, None), (3, "  "), (None, "token = 'abcdefgh12345'")], "item_id long, text string")
    got = contaminated(odd_docs, items).collect()
    assert sorted((str(r.doc_id), str(r.item_id), r.distance) for r in got) == [("5", "1", 0), ("5", "1", 0), ("7", "None", 0), ("None", "1", 0)]
    odd_docs = odd_docs.selectExpr("*", "1 AS _bad", "2 AS key", "3 AS row")
    kept = decontaminate(odd_docs, items)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4] and kept.columns == odd_docs.columns
    assert contaminated(odd_docs.limit(0), items).count() == 0 and contaminated(odd_docs, items.limit(0)).count() == 0


def test_null_ids_are_judged_by_their_own_text(spark, odd_docs):
    items = spark.createDataFrame([(1, "the same text twice in this table")], "item_id long, text string")
    clean = spark.createDataFrame([(None, "Another row without an id, and clean.", "en", "a", 9, "x", None, 1), (None, None, "en", "a", 9, "x", None, 1)], odd_docs.schema)
    kept = decontaminate(odd_docs.unionByName(clean), items).filter("doc_id IS NULL").collect()
    assert sorted(str(r.text) for r in kept) == ["Another row without an id, and clean.", "None"]
