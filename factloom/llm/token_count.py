"""Token counts with a whole-token shortcut.

In the piece vocabulary a space (or the mark U+2581 that stands for one) only ever opens a piece or stands in a run of
spaces. So no merge crosses from another character to a space, and a text falls into pre-tokens, each a run of spaces
and the characters after it, that are encoded by themselves. A character that no vocabulary string holds is encoded as
its UTF-8 bytes and never merges either; of these the line feed also ends a pre-token. Both facts are proved from the
vocabulary before counting, and an error is raised if they don't hold. Which vocabulary strings encode alone as one
token is found once, with the library; those count 1 without encoding, and other pre-tokens are encoded once each and
kept in a bounded cache.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Pre-tokens that the cache of a worker holds before it starts again.
CACHE = 400_000
_PRETOKEN = re.compile(r" +[^ \n]*|[^ \n]+|\n")


class _Counts(dict):
    """Tokens of a pre-token; misses are encoded. A pre-token without a leading space follows a line feed."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.feed = len(self.model.encode("\n"))
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size()) if not self.model.is_control(i) and not self.model.is_unknown(i) and not self.model.is_byte(i)]
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces):
            raise ValueError("a vocabulary string holds an inner space or a line feed, so pre-tokens can't be cut there")
        encode = self.model.encode
        if encode("a  b\n") != encode("a") + encode(" b") + encode("x\n")[len(encode("x")) :]:
            raise ValueError("the model changes white space or adds no space before a text")
        self.alone = {"\n": 1}
        plain = [p.replace(MARK, " ") for p in pieces]
        for p, n in zip(plain, map(len, self.model.encode([self._framed(p) for p in plain]))):
            if n - self._extra(p) == 1:
                self.alone[p] = 1
        self.update(self.alone)

    def _framed(self, pre: str) -> str:
        """The text to encode: the library puts one space before it, so one is taken off, or a line feed set before."""
        return pre[1:] if pre[0] == " " and len(pre) > 1 else "\n" + pre

    def _extra(self, pre: str) -> int:
        return 0 if pre[0] == " " and len(pre) > 1 else self.feed

    def learn(self, pres: set[str]) -> None:
        """Encodes the pre-tokens of the set that aren't known, in one call of the library."""
        new = [p for p in pres if p not in self]
        if len(self) + len(new) > CACHE + len(self.alone):
            self.clear()
            self.update(self.alone)
            new = [p for p in pres if p not in self]
        for p, n in zip(new, map(len, self.model.encode([self._framed(p) for p in new], num_threads=1))):
            self[p] = n - self._extra(p)


@cache
def _counts(path: str) -> _Counts:
    return _Counts(path)


def count_tokens(texts: list[str], path: str) -> list[int]:
    """Tokens of each text, as the library's encode gives them without begin and end tokens."""
    counts = _counts(path)
    split, get = _PRETOKEN.findall, counts.__getitem__
    pres = [split(" " + (t.replace(MARK, " ") if MARK in t else t)) if t else [] for t in texts]
    counts.learn(set().union(*pres))
    return [sum(map(get, p)) for p in pres]


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for each row; ``path`` is that of a sentencepiece model.

    A null or empty text has 0 bytes and tokens. Whole texts are counted; strings of special tokens inside them are
    ordinary text. Repeated rows stay, and other columns play no part.
    """
    base = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = base.schema["key"].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            t = b.column("text")
            n = [x for at in range(0, len(t), 256) for x in count_tokens(t[at : at + 256].to_pylist(), path)]
            yield pa.RecordBatch.from_arrays([b.column("key"), pc.binary_length(t).cast(pa.int64()), pa.array(n, pa.int64())], names=["key", "n_bytes", "n_tokens"])

    out = base.mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
