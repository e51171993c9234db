"""Language identification by mixture inference over n-gram likelihoods.

Each text is taken as a mixture of languages. A word is generated by one language, with the probability that the
language's byte trigrams give it. Expectation-maximisation estimates the proportions of the languages in a text; the set
of languages is the one of the highest likelihood less a penalty for each language (half the logarithm of the number of
words, times a factor), found by taking the languages in the order of their proportions, until the penalty alone outweighs
the best set. A long text is scored piece by piece; what is kept of it is a number for each word and language.

Fitting counts trigrams of labelled texts: of all, or of a bounded sample (``FIT_DOCS`` for each language, chosen by a hash
of the text's id); scoring covers every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import CHUNK_BYTES, crc_mod, hidden, place_of, text_parts, with_fields, word_pieces

#: Texts of each language (about) from which the trigram counts are fitted.
FIT_DOCS = 1500
#: Trigram slots.
SLOTS = 1 << 16
ROUNDS = 6
PENALTY = 3.0
UNDETERMINED = "und"

#: Letters of ASCII lower-cased, other ASCII a space; bytes of other characters as they are.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes that part words.
NO_LETTERS = bytes(b for b in range(128) if _FOLD[b] == 32)


def _slots(folded: np.ndarray) -> np.ndarray:
    """Slot of the trigram that starts at each byte."""
    x = folded.astype(np.uint32)
    y = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    return (y * np.uint32(2654435761)) >> np.uint32(16)


def _folded(data: memoryview, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The folded bytes with two spaces before each text and at the end; where each text's own bytes start."""
    o = offsets.tolist()
    joined = b"  ".join([b"", *(data[s:e] for s, e in zip(o, o[1:])), b""]).translate(_FOLD)
    return np.frombuffer(joined, dtype=np.uint8), offsets[:-1] + 2 * np.arange(1, len(o))


@dataclass
class Model:
    """languages: sorted names. table: log likelihood in each language (row) of each slot (column)."""

    languages: list[str]
    table: np.ndarray

    def infer(self, data: memoryview, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions of the languages in each text (rows of zeros where it has no words), number of languages."""
        docs, many = len(offsets) - 1, len(self.languages)
        shares, sizes = np.zeros((docs, many)), np.zeros(docs, dtype=np.int64)
        scores, n = self._scores(data, offsets)
        if scores is None:
            return shares, sizes
        some = np.flatnonzero(n)
        n = n[some]
        begin = np.cumsum(n) - n
        chances = np.exp(scores - scores.max(axis=0))

        def mixed(p: np.ndarray) -> list[np.ndarray]:
            return [c * np.repeat(q, n) for c, q in zip(chances, p)]

        def em(p: np.ndarray, rounds: int) -> np.ndarray:
            for _ in range(rounds):
                x = mixed(p)
                total = np.float32(1) / (sum(x) + np.float32(1e-30))
                p = np.stack([np.add.reduceat(c * total, begin) for c in x]) / n.astype(np.float32)
            return p

        p = em(np.full((many, len(some)), 1.0 / many, dtype=np.float32), ROUNDS)
        place = np.argsort(np.argsort(-p, axis=0, kind="stable"), axis=0, kind="stable")
        best = np.full(len(some), -np.inf)
        chosen, size = np.zeros_like(p), np.zeros(len(some), dtype=np.int64)
        for k in range(1, many + 1):
            cost = PENALTY * (k - 1) * (1 + 0.5 * np.log(n))
            if (best >= -cost).all():  # no likelihood is above 1, as the likeliest language of each word counts 1
                break
            kept = np.where(place < k, p + np.float32(1e-9), np.float32(0))
            kept /= kept.sum(axis=0)
            fit = np.add.reduceat(np.log(sum(mixed(kept)) + np.float32(1e-30)), begin) - cost
            better = fit > best
            best = np.where(better, fit, best)
            chosen = np.where(better, kept, chosen)
            size[better] = k
        shares[some] = em(chosen, 2).T
        sizes[some] = size
        return shares, sizes

    def _scores(self, data: memoryview, offsets: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
        """Log likelihood of each word (column) in each language, None without words; words of each text."""
        if len(offsets) == 2 and len(data) > CHUNK_BYTES:
            parts = [self._scores_of(data[s:e], np.array([0, e - s])) for s, e in word_pieces(data, NO_LETTERS)]
            scores = [x for x, _ in parts if x is not None]
            return np.concatenate(scores, axis=1) if scores else None, sum(n for _, n in parts)
        return self._scores_of(data, offsets)

    def _scores_of(self, data: memoryview, offsets: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
        docs = len(offsets) - 1
        folded, starts = _folded(data, offsets)
        word = folded != 32
        first = np.flatnonzero(word[1:] & ~word[:-1]) + 1
        if not len(first) or not self.languages:
            return None, np.zeros(docs, dtype=np.int64)
        slots = _slots(folded)
        # A word's trigrams are those that start from the space before it to its last byte.
        scores = np.stack([np.add.reduceat(t[slots], first - 1) for t in self.table])
        return scores, np.diff(np.searchsorted(first, np.append(starts, len(folded))))

    def likeliest(self, data: memoryview, offsets: np.ndarray) -> list[str]:
        """The single language of the highest likelihood of each text, "" without words."""
        scores, n = self._scores(data, offsets)
        out = [""] * len(n)
        if scores is not None:
            some = np.flatnonzero(n)
            begin = (np.cumsum(n) - n)[some]
            for i, k in zip(some, np.stack([np.add.reduceat(x, begin) for x in scores]).argmax(axis=0)):
                out[i] = self.languages[k]
        return out


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", fit_docs: int | None = FIT_DOCS) -> Model:
    """Learns the trigram table from about ``fit_docs`` texts of each language, or from all if that is None. Rows of null text or language are left out.
    A language takes 256 KB of the model, and 512 KB while it is learnt."""
    docs = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where("t is not null and l is not null")
    counts = {r["l"]: r["count"] for r in docs.groupBy("l").count().collect()}  # a row for each language
    if not counts:
        return Model([], np.zeros((0, SLOTS), dtype=np.float32))
    sample = docs
    if fit_docs is not None:
        share = F.lit(0.0)
        for name, n in counts.items():
            share = F.when(F.col("l") == name, F.lit(min(1.0, fit_docs / n))).otherwise(share)
        sample = docs.where(F.pmod(F.xxhash64(F.col("k").cast("string"), "l"), F.lit(1 << 20)) < share * (1 << 20))
    names = sorted(counts)
    schema = pa.schema([("lang", pa.int32()), ("slot", pa.int32()), ("n", pa.int64())])

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(names), SLOTS), dtype=np.int64)
        number = {x: i for i, x in enumerate(names)}
        for b in it:
            langs = np.array([number[x] for x in b.column("l").to_pylist()], dtype=np.int64)
            for row, last, data, offsets in text_parts(b, "t"):
                if last == row + 1:
                    runs = [(data[s:e], np.array([0, e - s])) for s, e in word_pieces(data, NO_LETTERS)]
                else:
                    runs = [(data, offsets)]
                for part, ends in runs:
                    folded, starts = _folded(part, ends)
                    inside = np.flatnonzero((folded[1:-1] != 32) | (folded[:-2] != 32))
                    # The trigrams of a text start from the space before it on.
                    of = langs[row:last][np.searchsorted(starts - 1, inside, side="right") - 1]
                    slots = _slots(folded)[inside]
                    for k in np.unique(of):
                        sums[k] += np.bincount(slots[of == k], minlength=SLOTS)
        at = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(sums[at], pa.int64())], schema=schema)

    got = sample.mapInArrow(count, "lang int, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    sums = np.full((SLOTS, len(names)), 0.5)
    sums[got["slot"].to_numpy(), got["lang"].to_numpy()] += got["n"].to_numpy()
    return Model(names, np.log(sums / sums.sum(axis=0)).T.astype(np.float32).copy())


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred, score (the language's share of the words) and langs (each language of the text with its share).

    Every whole text is scored. A null, empty or letterless text has lang_pred ``und``, score 0 and no langs; a text
    with letters (of which ``²`` and ``Ⅷ`` are none) always has a learned language while the model has one. Equal shares go
    to the language first by name. Repeated rows stay; columns of these three names are replaced.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # 256 KB a language
    new = {"lang_pred": "string", "score": "double", "langs": "map<string,double>"}
    base, own = hidden(docs), place_of(docs, text)
    schema = with_fields(base, ", ".join(f"{k} {v}" for k, v in new.items()))

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in it:
            preds, scores, langs = [], [], []
            for _, _, data, offsets in text_parts(b, own):
                shares, _ = m.infer(data, offsets)
                tops = shares.argmax(axis=1) if m.languages else np.zeros(len(shares), dtype=int)
                for i, top in enumerate(tops):
                    has = m.languages and any(map(str.isalpha, str(data[offsets[i] : offsets[i + 1]], "utf-8")))
                    preds.append(m.languages[top] if has else UNDETERMINED)
                    p = float(shares[i, top]) if has else 0.0
                    scores.append(min(1.0, max(0.0, p)))
                    langs.append([(m.languages[j], float(shares[i, j])) for j in np.flatnonzero(shares[i] > 1e-6)] if has else [])
            more = [pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(langs, pa.map_(pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, *new])

    found = base.mapInArrow(score, schema)
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c.lower() not in new], *new)


def held_out(key: str = "doc_id", n: int = 4, which: int = 2):
    """Whether a document is kept from fitting: crc32 of its id's text, modulo ``n``, is ``which``."""
    return F.coalesce(crc_mod(key, n) == which, F.lit(False))
