"""Exact removal of repeated byte strings by ranks of a content-defined sample of positions.

A byte is removed if a string of ``length`` bytes that covers it also starts earlier: in a document of a smaller key,
or before in the same one. Prefix doubling would sort every position once for each doubled length, which takes a multiple
of the input on disk (README); here few positions are ranked, and each rank is taken from the text, not from two others.

* Rank of 25 bytes. Of the 76 positions whose 25-byte string lies within a 100-byte string, the one of the least hash
  (the leftmost) is its anchor. Equal 100-byte strings have equal anchors at equal distances, so it is enough to rank
  the anchors, about one position in 38, instead of all. Spark sorts them by rank; an anchor of a unique rank ends its
  strings' search there.
* Anchors of an equal rank are ranked again by the context: all the bytes of the strings that share the anchor. Of equal
  contexts, all but the earliest are repeats past the threshold at once, which settles the inside of every copy.
* Where an anchor's rank is shared but its context differs, at the edges of copies, the strings are taken in blocks of
  eight, aligned to the anchor, and ranked by the 93 bytes that all of a block share; then as before.
* In blocks whose rank is shared but whose context differs, each 100-byte string is sorted by its pair of 50-byte ranks,
  one at the position and one at the offset of 50; all but the earliest are repeats.

Ranks are 64-bit hashes, so that they needn't be numbered by a global sort. Strings are held equal where two of them agree:
rank and context of anchors and blocks, which cover the same bytes, or the two halves of a string. So n ranked strings are
confused with a probability of at most n squared / 2^65, 128 bits for whole contexts. Before each shuffle, every task keeps
only the earliest of equal rows, so that a string that most documents hold reaches the sort once a task; a sort is read as
a stream that remembers one row, and spills. A text longer than a kernel takes at once is read in overlapping pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import CHUNK_BYTES, cut, text_parts, with_fields

#: Rows that a task holds to find the earliest of equal ones before the shuffle.
HELD = 400_000

#: Bits of a position in what a kernel takes at once: at most CHUNK_BYTES and a string. Always as many, so that equal
#: strings have equal anchors wherever they stand.
_BITS = 21
_MASK = (1 << 64) - 1
_M = 0x9E3779B97F4A7C15
_INVERSE = pow(_M, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Powers:
    """Powers of the multiplier and of its inverse, grown as texts need them."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            def chain(m: int) -> np.ndarray:
                x = np.full(n, m & _MASK, dtype=np.uint64)
                x[0] = 1
                return np.multiply.accumulate(x)
            self.up, self.down = chain(_M), chain(_INVERSE)
        return self.up, self.down


_POWERS = _Powers()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Hashes:
    """Ranks of any substring of some bytes, by prefix sums modulo 2^64."""

    def __init__(self, data: np.ndarray) -> None:
        self.up, self.down = _POWERS.get(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * self.up[: len(data)], out=self.sums[1:])

    def at(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mix((self.sums[ends] - self.sums[starts]) * self.down[starts])

    def all(self, length: int) -> np.ndarray:
        n = max(0, len(self.sums) - length)
        return _mix((self.sums[length:] - self.sums[:n]) * self.down[:n])


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of x[i : i + w] for each i, by running minima of blocks of w from both ends."""
    n = len(x) - w + 1
    pad = -len(x) % w
    y = np.concatenate([x, np.full(pad, _MASK, dtype=np.uint64)]).reshape(-1, w)
    left = np.minimum.accumulate(y, axis=1).reshape(-1)
    right = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """For each anchor of the texts: rank, context rank, text number, first string start in the text, number of strings,
    distance of the last start from the anchor."""
    k = max(1, length // 4)
    w = length - k + 1
    empty = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty, empty
    h = Hashes(data)
    ranks = h.all(k)
    bits = np.uint64(_BITS)
    at = np.arange(len(ranks), dtype=np.uint64)
    low = _sliding_min((ranks >> bits << bits) | at, w)
    where = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    ok = np.zeros(len(where) + 1, dtype=np.int32)  # +1 where a text's string starts begin, -1 after the last
    sizes = np.diff(offsets)
    long = sizes >= length
    np.add.at(ok, offsets[:-1][long], 1)
    np.add.at(ok, offsets[1:][long] - length + 1, -1)
    ok = np.cumsum(ok[:-1]) > 0
    first = ok.copy()
    first[1:] &= ~ok[:-1] | (where[1:] != where[:-1])
    begin = offsets[:-1][long]
    first[begin] = True
    s = np.flatnonzero(first)
    last = ok.copy()
    last[:-1] &= ~ok[1:] | first[1:]
    e = np.flatnonzero(last)
    owner = np.searchsorted(offsets, s, side="right") - 1
    # empty texts share an offset with the next: the last text that starts there owns it
    a = where[s]
    with np.errstate(over="ignore"):
        context = _mix(h.at(s, e + length) + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + (a - s).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    return ranks[a], context, owner, s - offsets[owner], e - s + 1, a - e


def blocks(h: Hashes, s: np.ndarray, n: np.ndarray, lo: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """For each block of the strings that start in [s, s + n), whose last is ``lo`` before its anchor: rank, context rank,
    index of the range, first start, number of strings."""
    b = _block(length)
    hi = lo + n - 1
    many = hi // b - lo // b + 1
    of = np.repeat(np.arange(len(s)), many)
    g = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + (lo // b)[of]
    a = (s + hi)[of]
    far, near = np.minimum(b * g + b - 1, hi[of]), np.maximum(b * g, lo[of])
    with np.errstate(over="ignore"):
        rank = _mix(h.at(a - b * g, a - b * g + length - b + 1) + g.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        context = _mix(h.at(a - far, a - near + length) + (far * 65536 + near).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    return rank, context, of, a - far, far - near + 1


def _block(length: int) -> int:
    return min(8, max(1, length // 8))


# A row of a sort: rank, context, okey, place. place is start << 31 | lo << 16 | number of strings << 1, or, for a span
# that is settled before the sort, start << 1 | 1; such a row's context is the span's bytes.
_ROWS = "rank long, context long, okey long, place long"
_FOUND = "okey long, place long, size long, kind int"


def _rows(rank: np.ndarray, context: np.ndarray, okey: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    columns = [rank.view(np.int64), context.view(np.int64), okey, place]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["rank", "context", "okey", "place"])


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs of the union of spans; touching spans are one run."""
    o = np.argsort(starts, kind="stable")
    s, e = starts[o], np.maximum.accumulate(ends[o]) if len(o) else ends
    new = np.ones(len(s), dtype=bool)
    new[1:] = s[1:] > e[:-1]
    last = np.append(new[1:], True) if len(s) else new
    return s[new], e[last]


class _Earliest:
    """Collects rows and gives them back with only the earliest of equal ones, the others as settled spans."""

    def __init__(self, length: int) -> None:
        self.length, self.rows, self.held = length, [], 0

    def add(self, rank: np.ndarray, context: np.ndarray, okey: np.ndarray, s: np.ndarray, n: np.ndarray, lo: np.ndarray | int) -> Iterator[pa.RecordBatch]:
        if len(rank):
            self.rows.append((rank, context, okey, s << 31 | lo << 16 | n << 1))
            self.held += len(rank)
        if self.held >= HELD:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        rank, context, okey, place = (np.concatenate(x) for x in zip(*self.rows))
        self.rows, self.held = [], 0
        o = np.lexsort((place, okey, context, rank))
        rank, context, okey, place = rank[o], context[o], okey[o], place[o]
        again = np.zeros(len(o), dtype=bool)
        again[1:] = (rank[1:] == rank[:-1]) & (context[1:] == context[:-1])
        yield _rows(rank[~again], context[~again], okey[~again], place[~again])
        if again.any():
            keys, s = okey[again], place[again] >> 31
            names, number = np.unique(keys, return_inverse=True)
            s = s + (number << 33)
            s, e = merged(s, s + (place[again] >> 1 & 32767) + self.length - 1)
            keys = names[s >> 33]
            yield _rows(_mix(keys.view(np.uint64)), e - s, keys, (s & (1 << 33) - 1) << 1 | 1)


def _repeats(rows: DataFrame, length: int, last: bool) -> DataFrame:
    """Sorts rows by rank. Gives (okey, place, size, kind): kind 1 for spans of bytes to remove (start, bytes), kind 0,
    unless ``last``, for the earliest rows of contexts whose rank other contexts share."""

    def stream(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # the last row: its rank, context, whether its rank had other contexts before, and if not, the row
        for b in it:
            rank, context, okey, place = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            done = (place & 1) == 1
            out = [(okey[done], place[done] >> 1, context[done], np.ones(int(done.sum()), dtype=np.int32))]
            rank, context, okey, place = (x[~done] for x in (rank, context, okey, place))
            if len(rank):
                if rest is not None:
                    rank, context, okey, place = (np.concatenate([[x], y]) for x, y in zip(rest[:4], (rank, context, okey, place)))
                same = np.append(False, rank[1:] == rank[:-1])
                again = same & np.append(False, context[1:] == context[:-1])
                spans = again.copy()
                shared = np.zeros(len(rank), dtype=bool)
                if not last:
                    # a context's first row is open if its rank has another context before it, or after it
                    head = ~again
                    before = same & head  # not the first context of its rank
                    run = np.cumsum(~same)
                    many = np.bincount(run, weights=before, minlength=run[-1] + 1) > 0
                    shared = head & (before | many[run])
                    if rest is not None:
                        shared[0] &= not rest[4]  # it may have been given out already
                lo = 1 if rest is not None else 0
                spans[:lo] = False
                p = place[spans]
                out.append((okey[spans], p >> 31, (p >> 1 & 32767) + length - 1, np.ones(len(p), dtype=np.int32)))
                out.append((okey[shared], place[shared], place[shared] >> 1 & 32767, np.zeros(int(shared.sum()), dtype=np.int32)))
                if not last:
                    # what to remember: the first context's row while its rank has one context only; a later context's
                    # row stands for a rank that is known to be shared, and was given out with its own batch
                    r = int(np.flatnonzero(~same)[-1])
                    if many[run[-1]] or (rest is not None and r == 0 and rest[4]):
                        rest = (rank[-1], context[-1], okey[-1], place[-1], True)
                    else:
                        rest = (rank[r], context[r], okey[r], place[r], False)
                else:
                    rest = (rank[-1], context[-1], okey[-1], place[-1], True)
            columns = [np.concatenate(x) for x in zip(*out)]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int32())], names=["okey", "place", "size", "kind"])

    return rows.repartition("rank").sortWithinPartitions("rank", "context", "okey", "place").mapInArrow(stream, _FOUND)


def _anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Earliest(length)
        for b in it:
            okey = b.column("okey").to_numpy()
            for row, last, at, _, data, offsets in _runs(b, length - 1):
                rank, context, of, s, n, lo = anchors(np.frombuffer(data, dtype=np.uint8), offsets, length)
                yield from held.add(rank, context, okey[row:last][of], s + at, n, lo)
        yield from held.flush()

    return docs.mapInArrow(run, _ROWS)


def _finer_rows(docs: DataFrame, found: DataFrame, length: int, single: bool) -> DataFrame:
    """Rows of the blocks, or of the single strings, of the ranges of ``found`` that are open."""
    ranges = found.where("kind = 0").groupBy("okey").agg(F.collect_list("place").alias("places"))
    joined = docs.join(ranges.hint("shuffle_hash"), "okey")  # all columns, so that the exchange is the one of the result

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Earliest(length)
        for b in it:
            okeys, places = b.column("okey").to_numpy(), b.column("places")
            for row, last, at, stop, data, offsets in _runs(b, 3 * length):
                part = places.slice(row, last - row)
                place = part.flatten().to_numpy()
                of = np.repeat(np.arange(row, last), part.value_lengths().to_numpy())
                if at or stop < len(data):  # a piece of a long text: the ranges that start in it
                    inside = (place >> 31 >= at) & (place >> 31 < stop)
                    place, of = place[inside] - (at << 31), of[inside]
                h = Hashes(np.frombuffer(data, dtype=np.uint8))
                base = offsets[of - row]
                s, lo, n = place >> 31, place >> 16 & 32767, place >> 1 & 32767
                if single:
                    of = np.repeat(np.arange(len(s)), n)
                    p = (s + base)[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                    half = p + length // 2
                    rank, context, n = h.at(p, half), h.at(half, p + length), np.ones(len(p), dtype=np.int64)
                else:
                    rank, context, of, p, n = blocks(h, s + base, n, lo, length)
                yield from held.add(rank, context, okeys[row + _row_of(offsets, p)], p - offsets[_row_of(offsets, p)] + at, n, 0)
        yield from held.flush()

    return joined.mapInArrow(run, _ROWS)


def _runs(batch: pa.RecordBatch, beyond: int) -> Iterator[tuple[int, int, int, int, memoryview, np.ndarray]]:
    """Runs of texts as of ``text_parts``, and the pieces of a longer text, each of CHUNK_BYTES and the ``beyond`` bytes
    behind; with the text's positions from which and before which a piece's strings start (a run: 0 and its end)."""
    for row, last, data, offsets in text_parts(batch, "text"):
        if len(data) <= CHUNK_BYTES + beyond:
            yield row, last, 0, len(data), data, offsets
            continue
        for at in range(0, len(data), CHUNK_BYTES):
            piece = data[at : at + CHUNK_BYTES + beyond]
            yield row, last, at, at + CHUNK_BYTES, piece, np.array([0, len(piece)])


def _row_of(offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(offsets, at, side="right") - 1


def _ordered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The rows with a long column okey that is different in each row and orders them by the key (null first), then by
    the text. Where integer keys are unique, okey is the key; otherwise rows are numbered along a range-partitioned sort."""
    kind = docs.schema[key].dataType.simpleString()
    odd = docs.groupBy(key).count().where((F.col("count") > 1) | F.col(key).isNull())
    if kind in ("bigint", "int", "smallint", "tinyint") and odd.isEmpty():
        # never null, and declared so: else inner joins would filter their texts first, and not share the exchange
        return docs.withColumn("okey", F.coalesce(F.col(key).cast("long"), F.lit(0)))
    ordered = docs.repartitionByRange(F.col(key), F.xxhash64(text)).sortWithinPartitions(key, text)
    return cut(ordered.withColumn("okey", F.monotonically_increasing_id()))


def repeated_spans(docs: DataFrame, shuffled: DataFrame, length: int = 100) -> DataFrame:
    """(okey, spans) of the rows (okey long, text string) with bytes to remove; spans, maybe overlapping, are arrays of
    start and number of bytes. ``shuffled``: the same rows, partitioned by okey."""
    first = _repeats(_anchor_rows(docs, length), length, last=False)
    second = _repeats(_finer_rows(shuffled, first, length, single=False), length, last=False)
    third = _repeats(_finer_rows(shuffled, second, length, single=True), length, last=True)
    found = first.unionByName(second).unionByName(third).where("kind = 1")
    return found.groupBy("okey").agg(F.collect_list(F.struct("place", "size")).alias("spans"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 100, digest: bool = False) -> DataFrame:
    """Removes every byte covered by a string of ``length`` UTF-8 bytes that also starts earlier.

    Returns (key, n_bytes, n_removed, n_spans) and, with ``digest``, kept_sha256 of the remaining bytes; else the
    remaining bytes as ``kept`` (binary: a cut may fall inside a character) and the other columns of ``docs`` as the
    struct ``rest``. A null text is empty; texts of fewer than ``length`` bytes have nothing removed. Matches never cross
    rows. Rows of equal keys are ordered by their texts (equal rows in any order), null keys come first. Bytes are judged
    on the input: what one row loses still counts as an earlier copy for the next.
    """
    if not 4 <= length <= 40_000:  # positions within a string take 15 bits, those in a text (2 GB at most) 31
        raise ValueError("length must be from 4 to 40000")
    others = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("rest")] * (not digest)
    base = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), *others)
    base = _ordered(base, "key", "text")
    # One shuffle of the texts serves all joins: the exchange is the same in each of them.
    texts = base.repartition("okey")
    spans = repeated_spans(base.select("okey", "text"), texts, length)
    joined = texts.join(spans.hint("shuffle_hash"), "okey", "left")
    counts = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64()} | ({"kept_sha256": pa.string()} if digest else {"kept": pa.binary()})

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            spans = b.column("spans")
            lengths = np.nan_to_num(spans.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            ends = np.cumsum(lengths)
            flat = spans.flatten()
            begin, size = flat.field("place").to_numpy(), flat.field("size").to_numpy()
            for row, last, data, offsets in text_parts(b, "text"):
                for i in range(row, last):
                    t = data[offsets[i - row] : offsets[i - row + 1]]
                    x = begin[ends[i] - lengths[i] : ends[i]]
                    s, e = merged(x, x + size[ends[i] - lengths[i] : ends[i]])
                    edges = np.concatenate([[0], np.stack([s, e], axis=1).reshape(-1), [len(t)]]).tolist()
                    parts = [t[p:q] for p, q in zip(edges[::2], edges[1::2])]
                    if digest:
                        h = hashlib.sha256()
                        for p in parts:
                            h.update(p)
                        kept = h.hexdigest()
                    else:
                        kept = b"".join(parts)
                    rows.append((len(t), int((e - s).sum()), len(s), kept))
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows) if rows else [[]] * 4, counts.values())]
            front = [b.column("key")] + ([] if digest else [b.column("rest")])
            yield pa.RecordBatch.from_arrays([*front, *columns], names=["key", *([] if digest else ["rest"]), *counts])

    front = base.select("key", *([] if digest else ["rest"]))
    schema = with_fields(front, "n_bytes long, n_removed long, n_spans long, " + ("kept_sha256 string" if digest else "kept binary"))
    return joined.mapInArrow(run, schema).withColumnRenamed("key", key)


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 100) -> DataFrame:
    """The rows, with the columns, of ``docs`` with repeated bytes cut out of the text; a row all of whose bytes were
    repeats goes. Bytes that a cut leaves of a character go with it."""
    found = remove_repeats(docs, key, text, length).where("n_bytes = 0 or n_removed < n_bytes")
    clean = F.try_validate_utf8(F.col("kept").cast("string"))
    left = F.when(F.col("n_removed") == 0, F.col("kept").cast("string")).otherwise(F.coalesce(clean, F.replace(F.make_valid_utf8(F.col("kept").cast("string")), F.lit("\ufffd"), F.lit(""))))
    return found.select(*[(left if c == text else F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])
