import math
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from loomspark.llm import packing
from loomspark.llm.packing import Index, WordIds, fill, ordered, pack, ranking

FILE = public_tokenizers.path("word_bpe_49k.json")


def check(docs, rows, window, shard):
    tokenizer = Tokenizer.from_file(FILE)
    ids = [np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4") for r in rows]
    got = pack(docs, FILE, window, shard).collect()
    by_doc, by_sequence = {}, {}
    for p in got:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert sum(p.length for p in got) == sum(map(len, ids))
    own = {}
    for r, x in zip(rows, ids, strict=True):
        own.setdefault(r.doc_id, []).append(x)
    for doc_id, pieces in by_doc.items():
        x, copies = own[doc_id][0], len(own[doc_id])
        assert sum(p.length for p in pieces) == len(x) * copies
        for p in pieces:
            assert p.doc_tokens == len(x) and p.ids_crc32 == zlib.crc32(x[p.start : p.start + p.length].tobytes())
        if copies == 1:
            pieces.sort(key=lambda p: p.start)
            assert [p.start for p in pieces] == list(np.cumsum([0, *(p.length for p in pieces[:-1])]))
    for pieces in by_sequence.values():
        pieces.sort(key=lambda p: p.offset)
        assert [p.offset for p in pieces] == list(np.cumsum([0, *(p.length for p in pieces[:-1])]))
        size = sum(p.length for p in pieces)
        assert size <= window and size & (size - 1) == 0


def test_every_id_in_one_piece(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(f"word{rng.randrange(60)} é{rng.randrange(9)}" for _ in range(rng.randrange(0, 120)))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(docs, docs.collect(), 256, 3000)


def test_odd_rows(spark, odd_docs):
    check(odd_docs, odd_docs.collect(), 1024, 10_000)
    assert pack(odd_docs.limit(0), FILE).count() == 0


def test_word_ids_equal_the_tokenizer():
    tokenizer, words, rng = Tokenizer.from_file(FILE), WordIds(FILE, limit=500), random.Random(1)
    bits = ["The", "it's", "'RE", "x", "9", "12", "é", "É", "e\u0301", "\u0301", "ß", "İ", "ΣΑΣ", "日本", "🙂", "<|endoftext|>", "<|", "...", "_", " ", " ", "\t", "\n", "\u00a0", "\u3000", "--", "\x00", "\x1c", "\x85", "\u200b", "ﬁ", "don't", "'s", "w" * 250, "½", "²", "¡Ñandú", "ŁÓDŹ", "ǅ", "ƀɏ", "\xad", "\x7f", "ª", "'ſ", "l'été", "€"]
    assert words.fast
    texts = ["".join(rng.choices(bits, k=rng.randrange(0, 9))) for _ in range(20_000)]
    for a in range(0, len(texts), 40):
        for text, got in zip(texts[a : a + 40], words.of(texts[a : a + 40]), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2], repr(text)


def test_other_tokenizers_encode_whole_texts(spark):
    file = public_tokenizers.path("byte_bpe_50k.json")
    words, tokenizer = WordIds(file, 50256), Tokenizer.from_file(file)
    text = "The  same words,\n twice  over. The  same words"
    assert not words.fast and np.frombuffer(words.of([text])[0], "<u4").tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 50256]


def test_greedy_filling_equals_brute_force():
    """Whole windows against a plain ranking: the seed, then its neighbours by BM25 that fit, then the best one cut."""
    rng = np.random.default_rng(11)
    ids = [np.array([*rng.zipf(1.6, rng.integers(5, 60)) % 400 + 3, 2], "<u4") for _ in range(120)]
    free, window, want = [True] * len(ids), 128, []
    current, room = [], window

    def place(d):
        nonlocal current, room
        free[d], at = False, 0
        while at < len(ids[d]):
            n = min(room, len(ids[d]) - at)
            current.append((d, at, n))
            at, room = at + n, room - n
            if not room:
                want.append(current)
                current, room = [], window

    while any(free):
        if not current:
            place(free.index(True))
            continue
        scores, full, cut = bm25(ids, current[0][0]), len(want), None
        for d in sorted((d for d in range(len(ids)) if free[d] and scores[d] > 0), key=lambda d: (-scores[d], d)):
            if len(ids[d]) <= room:
                place(d)
            elif cut is None:
                cut = d
            if len(want) > full:
                break
        if len(want) == full:
            place(free.index(True) if cut is None and any(free) else cut) if cut is not None or any(free) else None
    got = fill(ids, window)
    assert got == want + ([current] if current else [])


def bm25(ids, seed, k1=1.2, b=0.75):
    texts = [x[:-1].tolist() for x in ids]
    mean, scores = max(sum(map(len, texts)) / len(texts), 1), np.zeros(len(ids))
    for term in set(texts[seed]):
        df = sum(term in t for t in texts)
        for i, t in enumerate(texts):
            tf = t.count(term)
            scores[i] += math.log1p((len(ids) - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(t) / mean)) if tf else 0
    return scores


def test_scores_count_all_terms_and_all_documents(monkeypatch):
    rng = np.random.default_rng(4)
    ids = [np.array([*rng.integers(3, 300, rng.integers(0, 120)), 2], "<u4") for _ in range(150)]
    monkeypatch.setattr(packing, "POSTINGS", 300)
    index, free = Index([x[:-1] for x in ids]), np.ones(150, bool)
    for seed in range(0, 150, 7):
        free[seed] = False
        want = np.where(free, bm25(ids, seed), 0)
        assert np.allclose(index.scores(seed, free), want)
        best, rest = ranking(want, 10)
        assert [*best, *ordered(want, rest)] == sorted(np.flatnonzero(want > 0), key=lambda d: (-want[d], d))
        if seed % 2:
            index.drop(free)


def test_windows_take_every_neighbour_that_fits():
    # The seed has terms 3 to 42; 70 documents share three of them, 40 none.
    seed = np.array([*range(3, 43), 2], "<u4")
    strangers = [np.array([*range(1000 + 9 * i, 1009 + 9 * i), 2], "<u4") for i in range(40)]
    weak = [np.array([40, 41, 42, 5000 + i, 2], "<u4") for i in range(70)]
    windows = fill([seed, *strangers, *weak], 512)
    assert sum(d > 40 for d, _, _ in windows[0]) == 70  # all 70 neighbours before any stranger


def test_a_seed_whose_weightiest_terms_no_other_has():
    seed = np.array([*range(100, 130), *range(3, 13), 2], "<u4")
    others = [np.array([*range(200 + 9 * i, 209 + 9 * i), 2], "<u4") for i in range(20)]
    windows = fill([seed, *others, np.array([*range(3, 13), 2], "<u4")], 64)
    assert [d for d, _, _ in windows[0]][:2] == [0, 21]


def test_words_of_latin_texts_are_kept_once_in_lower_case():
    tokenizer, words = Tokenizer.from_file(FILE), WordIds(FILE)
    words.of(["The THE the tHE"])
    assert len(words.known) == 1
    for text in ["H\u0331 h\u0331 I\u0307", "<|ENDOFTEXT|> <|endoftext|>", "ÀÉ ÞÞ µ ß Ÿ ÿ", "ΑΣ ΑΣ."]:
        assert np.frombuffer(words.of([text])[0], "<u4").tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2], text


def test_common_terms_in_a_matrix_score_as_lists_do(monkeypatch):
    rng = np.random.default_rng(8)
    ids = [np.array(rng.zipf(1.4, rng.integers(0, 90)) % 70_000, "<u4") for _ in range(90)]
    for dense in (1, 4, 90):
        monkeypatch.setattr(packing, "DENSE", dense)
        index, free = Index(ids), np.ones(90, bool)
        for seed in range(0, 90, 9):
            free[seed] = False
            want = np.where(free, bm25([np.append(x, 2) for x in ids], seed), 0)
            assert np.allclose(index.scores(seed, free), want)
            index.drop(free)
