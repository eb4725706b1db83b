import hashlib
import math
import random
import re

from pyspark.sql import functions as F

from loomspark.llm.secrets_scan import CANDIDATE, CLASSES, ENCODINGS, KINDS, PRIOR, SPREAD, STRETCH, _bin, battery, encoding, null_counts, scan, structured, thresholds

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def check(spark, docs):
    got = scan(docs).collect()
    texts = docs.select("doc_id", "text").collect()
    assert len(got) == len(texts)
    by_id = {}
    for r in texts:
        by_id[r.doc_id] = base(r.text)
    for r in got:
        want = by_id[r.doc_id]
        joined = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in want) for i in range(3))
        spans = [x for x in r.spans.split(",") if x]
        assert [x for x in spans if not x.startswith("random")] == [x for x in joined.split(",") if x]
        assert len(spans) == len(want) + r.n_random


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(5)
    bits = ["secret", "TOKEN", "api_key", "apikey", "passwd", "Password", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "deadbeef", "é", "🙂", "\n", "x", "abcdefgh", "-", "."]
    rows = [(i, "".join(rng.choices(bits, k=rng.randint(0, 40)))) for i in range(400)]
    check(spark, spark.createDataFrame(rows, "doc_id long, text string"))


def test_odd_rows(spark, odd_docs):
    check(spark, odd_docs)
    check(spark, odd_docs.limit(0))


def test_many_matches_in_one_text(spark):
    text = " ".join(f"token={i:08d} AKIA{'A' * 12} {'é' if i % 3 else ''}{'0123abcd' * 4}" for i in range(2000))
    check(spark, spark.createDataFrame([(1, text), (2, "x" * 200_000), (3, "secret: " * 3000)], "doc_id long, text string"))


def prose(rng, n):
    return " ".join("".join(rng.choices("eeeetttaaooinnsshrrdlucmfywgpbvk", k=rng.randint(1, 9))) for _ in range(n)).capitalize()


def test_random_tokens_are_told_from_structured_ones(spark):
    rng = random.Random(7)
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    base36 = "abcdefghijklmnopqrstuvwxyz0123456789"
    rows = [(i, f"{prose(rng, 150)} key {''.join(rng.choices(base64, k=44))} end") for i in range(200)]
    rows += [(500 + i, f"{prose(rng, 150)} key {''.join(rng.choices(base36, k=90))} end") for i in range(200)]
    rows += [(1000 + i, f"{prose(rng, 150)} id aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1111111111{i:04d} end") for i in range(200)]
    rows += [(2000 + i, f"{prose(rng, 150)} ref item-item-item-item-{i:04d}-item-item-item-item end") for i in range(200)]
    rows += [(3000 + i, f"{prose(rng, 150)} see {prose(rng, 9).replace(' ', '')[:40]}2024 end") for i in range(200)]
    rows += [(4000 + i, prose(rng, 200)) for i in range(1500)]
    got = {r.doc_id: r.n_random for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    count = lambda first: sum(got[first + i] for i in range(200))
    assert count(0) >= 180 and count(500) >= 120
    reported = sum(got.values())
    assert reported - count(0) - count(500) <= 0.1 * reported  # false discoveries, controlled at 5 %


def fdr(candidates, null):
    """The whole rule in plain Python, from (kind, class, bin) of candidates and of null windows: which are reported."""
    p = {}
    for cell in set(candidates):
        own = [b for k, c, b in null if (k, c) == cell[:2]]
        n = len(own) + PRIOR
        logs = [math.log1p(b) for b in own]
        mean = sum(logs) / n
        spread = max(math.sqrt(max(sum(y * y for y in logs) / n - mean * mean, 0)), SPREAD)
        z = (mean - math.log1p(cell[2])) / spread
        tail = 1 / (1 + math.exp(max(min(1.5976 * z + 0.07056 * z**3, 300), -300)))
        p[cell] = max(sum(b <= cell[2] for b in own) / n, tail)
    out = set()
    for c, (_, rate) in enumerate(CLASSES):
        own = sorted(p[x] for x in candidates if x[1] == c)
        cut = max((v for v in own if v <= sum(w <= v for w in own) * rate / len(own)), default=0)
        out |= {x for x in candidates if x[1] == c and p[x] <= cut}
    return out


def test_thresholds_equal_brute_force(spark):
    rng = random.Random(3)
    for trial in range(3):
        null = [(rng.randrange(3), rng.randrange(len(CLASSES)), min(240, int(rng.expovariate(0.02)))) for _ in range(400)]
        found = [(rng.randrange(3), rng.randrange(len(CLASSES)), rng.choice([0, 1, 2, 3, 8, 40, 200])) for _ in range(60)]
        kind = "array<struct<kind:int,c:int,bin:int>>"
        scored = spark.createDataFrame([(found[i::5], null[i::5]) for i in range(5)], f"r {kind}, null {kind}")
        greatest = thresholds(scored)
        assert {x for x in found if x[2] <= greatest.get(x[:2], -1)} == fdr(found, null), trial


def test_encodings_and_battery(spark):
    rows = [("deadbeef01", 0), ("DEADBEEF01", 1), ("ABCZ234567", 2), ("zz09", 3), ("ZZ09", 4), ("aZ19", 5), ("aZ0l", 6), ("a-Z", 7)]
    df = spark.createDataFrame(rows, "t string, kind int")
    assert all(r.e == r.kind for r in df.select("kind", encoding(df.t).alias("e")).collect())
    tokens = spark.createDataFrame([("9f86d081884c7d659a2feaa0c55ad015", 0), ("aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1", 0), ("abababababababababababababababab", 0)], "t string, kind int")
    mixed, same, alternating = (r.p for r in tokens.select(battery(tokens.t, tokens.kind).alias("p")).collect())
    assert mixed > 1e-3 and same < 1e-9 and alternating < 1e-9


def keyed_texts(n, every, length, seed):
    """Prose of which `every`-th text holds a random base-62 key."""
    rng = random.Random(seed)
    base62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rows = []
    for i in range(n):
        key = "".join(rng.choices(base62, k=length - 2)) + "a7"
        rows.append((i, f"{prose(rng, 150)} key {key} end" if every(i) else prose(rng, 150)))
    return rows


def share_found(spark, n, every, length, seed=11):
    rows = keyed_texts(n, every, length, seed)
    got = {r.doc_id: r.n_random for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    holders = [i for i in range(n) if every(i)]
    assert not any(got[i] for i in range(n) if not every(i))
    return sum(got[i] for i in holders) / len(holders)


def test_keys_are_found_whatever_their_density(spark):
    sparse, dense = lambda i: i % 10 == 0, lambda i: i % 7 != 0
    assert share_found(spark, 400, sparse, 32) >= 0.8 and share_found(spark, 400, dense, 32) >= 0.8


def test_whole_texts_give_the_null_distribution(spark):
    """Windows come from every stretch, and never from a candidate."""
    rng = random.Random(2)
    long = prose(rng, 4000)
    key = "q7" * 40
    df = spark.createDataFrame([(long,), ((key + " ") * 300,), ("",)], "text string")
    got = [r.w for r in df.select(structured(df.text).alias("w")).collect()]
    stretches = -(-len(long) // STRETCH)
    assert 2 * (stretches - 1) <= sum(x.c == 0 for x in got[0]) <= 2 * stretches and not got[1] and not got[2]
    assert len({x.kind for x in got[0]}) == 8


def test_the_null_distribution_has_all_windows(spark):
    """Every window of every text counts, in all encodings, and scores as in the battery."""
    rng = random.Random(4)
    texts = [prose(rng, n) for n in (0, 3, 40, 700)] + ["q7" * 40 + " é " + prose(rng, 30), "Straße 12 " * 9, "", None, "0" * 15 + " " + "A" * 15]
    windows = []
    for text in texts:
        rest = re.sub(CANDIDATE, "", text or "")
        for kind, (chars, _, _) in enumerate(ENCODINGS):
            case = [str.lower, str.upper, str.upper, str.lower, str.upper, str, str, str][kind]
            own = re.sub(f"[^{chars}]", "", case("".join(c for c in rest if ord(c) < 128)))
            for c, (n, _) in enumerate(CLASSES):
                if len(own) >= n:
                    windows += [(own[i : i + n], kind, c) for i in (min(j, len(own) - n) for j in range(0, len(own), n))]
    df = spark.createDataFrame(windows, "t string, kind int, c int")
    want = df.withColumn("bin", _bin(battery(df.t, df.kind))).groupBy("kind", "c", "bin").count().collect()
    got = null_counts(spark.createDataFrame([(t,) for t in texts], "text string")).groupBy("kind", "c", "bin").agg(F.sum("k").alias("k")).collect()
    assert {(r.kind, r.c, r.bin): r["count"] for r in want} == {(r.kind, r.c, r.bin): r.k for r in got}


def test_windows_of_all_letters_about_the_borders_of_chunks(spark):
    """Texts with all letters of the widest encodings, with lengths about multiples of 64 and of the windows."""
    rng = random.Random(6)
    letters = ENCODINGS[-1][1]
    rows = []
    for n in [15, 16, 17, 63, 64, 65, 79, 80, 81, 127, 128, 129, 143, 144, 145, 159, 160, 161, 209]:
        own = "".join(rng.choices(letters, k=n)) if n % 3 else letters[-1] * (n - 5) + "_-/+Z"
        rows.append((own, " ".join(own[i : i + 9] for i in range(0, n, 9))))
    windows = []
    for own, _ in rows:
        for c, (n, _) in enumerate(CLASSES):
            if len(own) >= n:
                windows += [(own[i : i + n], len(ENCODINGS) - 1, c) for i in (min(j, len(own) - n) for j in range(0, len(own), n))]
    df = spark.createDataFrame(windows, "t string, kind int, c int")
    want = df.withColumn("bin", _bin(battery(df.t, df.kind))).groupBy("c", "bin").count().collect()
    got = null_counts(spark.createDataFrame(rows, "own string, text string")).filter(F.col("kind") == len(ENCODINGS) - 1).collect()
    assert {(r.c, r.bin): r["count"] for r in want} == {(r.c, r.bin): r.k for r in got}


def test_the_null_distribution_runs_no_python(spark):
    """DataFrame functions only, which are fused to no method that the JVM leaves uncompiled (8000 bytes of code)."""
    plan = null_counts(spark.createDataFrame([("some words",)], "text string").cache())._jdf.queryExecution()
    assert not re.search("Python|Pandas|Arrow", plan.executedPlan().toString())
    stages = plan.debug().codegenToSeq()
    assert all(stages.apply(i)._3().maxMethodCodeSize() < 8000 for i in range(stages.size()))


def test_letters_are_read_twice_whatever_the_alphabet_and_the_windows(spark):
    """Rows of 96 and of 80 letters, and one more of each per text, give the windows of all classes (F1)."""
    from loomspark.llm.secrets_scan import _rows, _windows

    rng = random.Random(9)
    lengths = [15, 16, 79, 80, 81, 95, 96, 97, 159, 160, 161, 191, 192, 193, 239, 240, 241, 479, 480, 481, 960]
    letters = "".join(rng.choices("ghijklmnopqrstuvwxyz", k=1000))  # no hexadecimal ones
    df = spark.createDataFrame([(" ".join(letters[i : min(i + 9, n)] for i in range(0, n, 9)),) for n in lengths], "text string")
    wide = {n: (n // 96 + (n % 96 >= 16) + 1) for n in lengths if n >= 16}
    narrow = {n: (n // 80 + (n % 80 >= 20) + 1) for n in lengths if n >= 16}
    got = {(r.held, r.wide): r["count"] for r in _rows(df).filter("kind = 7").groupBy("held", "wide").count().collect()}
    assert got == {(n, True): k for n, k in wide.items()} | {(n, False): k for n, k in narrow.items()}
    windows = sum(n // least + (n % least > 0) for n in lengths for least, _ in CLASSES if n >= least)
    assert _windows(df).filter("kind = 7").count() == windows


def test_rare_letters_count_in_all_windows_of_a_row(spark):
    """Letters beyond the 63 that one long has room for, next to others and in every place."""
    rng = random.Random(8)
    letters = ENCODINGS[-1][1]
    owns = ["".join(rng.choices(letters[-4:] + letters[:3], k=n)) for n in (96, 101, 480, 497)]
    windows = [(own[i : i + n], c) for own in owns for c, (n, _) in enumerate(CLASSES) for i in (min(j, len(own) - n) for j in range(0, len(own), n))]
    df = spark.createDataFrame(windows, "t string, c int").withColumn("kind", F.lit(len(ENCODINGS) - 1))
    want = df.withColumn("bin", _bin(battery(df.t, df.kind))).groupBy("c", "bin").count().collect()
    got = null_counts(spark.createDataFrame([(" ".join(own[i : i + 7] for i in range(0, len(own), 7)),) for own in owns], "text string"))
    assert {(r.c, r.bin): r["count"] for r in want} == {(r.c, r.bin): r.k for r in got.filter(F.col("kind") == len(ENCODINGS) - 1).collect()}
