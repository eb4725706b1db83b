"""Token counts with a whole-token shortcut (operator 2).

A sentencepiece BPE model whose vocabulary has no piece with a space mark after another character, and none with a
line feed, never merges across those places. A text then falls into pre-tokens that encode alone: a word with the
spaces before it, or a line feed with the characters up to the next space or line feed. Vocabulary strings proven to
encode alone as one token count 1 by lookup; only the other pre-tokens are merged by the library, once each.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import sliced

MARK = "▁"
_PRETOKEN = re.compile(r"\n[^ \n]*| +[^ \n]*|[^ \n]+")


def whole_tokens(encode, pieces: list[str]) -> dict[str, int]:
    """Words (without the mark before them) whose piece is proven, by encoding it alone, to be one token."""
    words = [p[1:] for p in pieces if p.startswith(MARK) and MARK not in p[1:] and len(p) > 1]
    return {w: 1 for w, ids in zip(words, encode(words, num_threads=1), strict=True) if len(ids) == 1}


def splits_exactly(pieces: list[str]) -> bool:
    """Whether no piece crosses a pre-token boundary, so that counts of pre-tokens add up to the text's."""
    return not any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in pieces)


class PieceCounter(dict):
    """Tokens by pre-token. Holds the proven words and at most `limit` merged pre-tokens, then starts anew."""

    def __init__(self, model_file: str, limit: int = 1_000_000):
        import sentencepiece

        self.encode = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.encode.id_to_piece(i) for i in range(self.encode.get_piece_size())]
        self.exact = splits_exactly(pieces)
        self.encode = self.encode.encode
        self.proven = whole_tokens(self.encode, pieces)
        self.limit = limit
        super().__init__(self.proven)

    def __missing__(self, word: str) -> int:
        n = len(self.encode(word)) - (word[:1] == "\n")  # the library puts a mark, a token of its own, before a line feed
        if len(word) <= 100:
            if len(self) >= self.limit:
                self.clear()
                self.update(self.proven)
            self[word] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.exact:
            return len(self.encode(text))
        if MARK in text:
            text = text.replace(MARK, " ")
        if "  " in text or " \n" in text or text[0] in " \n" or text[-1] == " ":
            return sum(map(self._run, _PRETOKEN.findall(" " + text)))
        return sum(map(self.__getitem__, text.replace("\n", " \n").split(" ")))

    def _run(self, pre: str) -> int:
        if pre[0] != " ":
            return self[pre]
        word = pre.lstrip(" ")
        spaces = len(pre) - len(word)
        if spaces == 1:
            return self[word] if word else 1
        return len(self.encode(" " * (spaces - 1) + word))


@lru_cache(maxsize=2)
def _counter(model_file: str) -> PieceCounter:
    return PieceCounter(model_file)


def token_counts(docs: DataFrame, model_file: str, max_tokens: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > max_tokens).

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows and null ids are kept as they are; other columns of
    docs are not read, so their names cannot clash. A model that fails the boundary proof is counted by whole texts.
    """

    def count(batches):
        counter = _counter(model_file)
        for batch in sliced(batches):
            texts = batch.column(1).to_pylist()
            n = [counter.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > max_tokens for x in n], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(count, f"`{id_col}` {id_type}, n_bytes long, n_tokens long, over_limit boolean")
