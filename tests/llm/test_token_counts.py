import random

import public_tokenizers
import sentencepiece

from loomspark.llm.token_counts import PieceCounter, splits_exactly, token_counts, whole_tokens

FILE = public_tokenizers.path("piece_bpe_32k.model")


def test_counts_equal_the_library():
    library, rng = sentencepiece.SentencePieceProcessor(model_file=FILE), random.Random(2)
    counter = PieceCounter(FILE, limit=20_000)
    assert counter.exact
    bits = [" ", "  ", "\n", "a", "the", "▁", "é", "\t", "ing", "<s>", "</s>", "\r\n", "日本", "🙂", " ", ".", "<0x0A>", "\x00", "x" * 150]
    for _ in range(20_000):
        text = "".join(rng.choices(bits, k=rng.randrange(0, 12)))
        assert counter.count(text) == len(library.encode(text)), repr(text)


def test_proof():
    library = sentencepiece.SentencePieceProcessor(model_file=FILE)
    pieces = [library.id_to_piece(i) for i in range(library.get_piece_size())]
    proven = whole_tokens(library.encode, pieces)
    assert len(proven) > 10_000 and all(len(library.encode(w)) == 1 for w in list(proven)[::50])
    assert splits_exactly(pieces) and not splits_exactly([*pieces, "a▁b"]) and not splits_exactly(["\nx"])


def test_odd_rows(spark, odd_docs):
    library = sentencepiece.SentencePieceProcessor(model_file=FILE)
    want = sorted((str(r.doc_id), len((r.text or "").encode()), len(library.encode(r.text or "")), len(library.encode(r.text or "")) > 4096) for r in odd_docs.collect())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(odd_docs, FILE).collect()) == want
    assert token_counts(odd_docs.limit(0), FILE).count() == 0
