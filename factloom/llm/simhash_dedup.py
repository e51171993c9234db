"""SimHash near-duplicates, joined by the pigeonring principle.

A fingerprint has 64 bits; two of them link if they differ in at most ``BUDGET`` = 2. The bits form a ring of five
segments. Pigeonhole filtering would ask for one segment of at most 2/5 differences, so an equal one. The pigeonring
principle (Qin and Xiao, 2018) is stronger: some segment i begins a chain whose every prefix of k segments has at most
2k/5 differences. So segments i and i+1 are equal (budgets 0.4 and 0.8), the first three differ in at most one bit, the
first four in at most one (1.6), and all five in at most two. Of the third and the fourth segment one is therefore equal
as well, and the join key is the start, which of them it is, and three equal segments, 38 or 39 bits. The chain is then
checked in full before the Hamming distance.

Only distinct fingerprints are joined: rows of one fingerprint are members of it. A fingerprint has at most 2,080
others within two bits, so links stay in proportion to the fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import CHUNK_BYTES, cut, hidden, lower_ascii, place_of, text_parts, word_pieces
from factloom.llm.graph import components

BUDGET = 2
WIDTHS = (13, 13, 13, 13, 12)
SHIFTS = (0, 13, 26, 39, 52)
SEED = 42

_LOWER = lower_ascii()
_SPACES = b" \t\n\v\f\r"
#: For a byte, a 64-bit word with a lane of eight bits for each of its bits.
_LANES = np.array([sum(1 << 8 * j for j in range(8) if b >> j & 1) for b in range(256)], dtype=np.uint64)


def shingle_hashes(text: bytes, width: int) -> list[int]:
    """XXH64 of each shingle of ``width`` words of the lower-cased text, or of all its words if there are fewer."""
    words = text.translate(_LOWER).split()
    if words and len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    return _inner_hashes(words, width)


def _inner_hashes(words: list[bytes], width: int) -> list[int]:
    if len(words) < width or not words:
        return []
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    return [h(joined[s:e], SEED) for s, e in zip(starts, ends[width - 1 :].tolist())]


def hash_parts(text: memoryview | bytes, width: int) -> Iterator[np.ndarray]:
    """The hashes of ``shingle_hashes``, of a long text piece by piece."""
    pieces = list(word_pieces(text, _SPACES))
    if len(pieces) <= 1:
        yield np.array(shingle_hashes(bytes(text), width), dtype=np.uint64)
        return
    before: list[bytes] = []
    some = False
    for s, e in pieces:
        words = before + bytes(text[s:e]).translate(_LOWER).split()
        got = _inner_hashes(words, width)
        some = some or bool(got)
        before = words[-(width - 1) :] if width > 1 else []
        yield np.array(got, dtype=np.uint64)
    if before and not some:
        yield np.array(shingle_hashes(b" ".join(before), width), dtype=np.uint64)


def fingerprints_of(texts: list[bytes], width: int) -> np.ndarray:
    """Fingerprints (uint64): bit i is 1 if it is set in over half of the text's shingle hashes; 0 without words."""
    out = np.zeros(len(texts), dtype=np.uint64)
    counts, block, firsts, hashes, owners = [], [], [], [], []
    at = 0
    for i, t in enumerate(texts):
        if len(t) > CHUNK_BYTES:
            out[i] = _long_fingerprint(t, width)
            continue
        h = shingle_hashes(t, width)
        if h:
            hashes.append(np.array(h, dtype=np.uint64))
            owners.append(i)
            counts.append(len(h))
            firsts.append(len(block))
            block.extend(range(at, at + len(h), 255))  # a lane holds 255 at most
            at += len(h)
    if hashes:
        lanes = _LANES[np.concatenate(hashes).view(np.uint8).reshape(-1, 8)]
        sums = np.add.reduceat(lanes, block, axis=0).view(np.uint8).astype(np.int64)  # a row of 64 counts a block
        bits = 2 * np.add.reduceat(sums, firsts, axis=0) > np.array(counts)[:, None]
        out[owners] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).reshape(-1)
    return out


def _long_fingerprint(text: bytes, width: int) -> np.uint64:
    """The fingerprint of a text that is read in pieces: its bits are counted piece by piece."""
    return simhash_of(hash_parts(text, width))


def simhash_of(parts: Iterable[np.ndarray]) -> np.uint64:
    """The fingerprint of the hashes (uint64) of all parts."""
    n, bits = 0, np.zeros(64, dtype=np.int64)
    for h in parts:
        n += len(h)
        for at in range(0, len(h), 255):
            bits += _LANES[h[at : at + 255].view(np.uint8).reshape(-1, 8)].sum(axis=0).view(np.uint8)
    return np.packbits(2 * bits > n, bitorder="little").view(np.uint64)[0]


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(key, hash of the text, fp long) for each row. Null, empty and wordless texts have fingerprint 0."""
    base = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    kind = base.schema["key"].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fps = [np.zeros(0, dtype=np.uint64)]
            for _, _, data, offsets in text_parts(b, "text"):
                o = offsets.tolist()
                fps.append(fingerprints_of([bytes(data[s:e]) for s, e in zip(o, o[1:])], width))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("hash"), pa.array(np.concatenate(fps).view(np.int64))], names=["key", "hash", "fp"])

    return base.mapInArrow(run, f"key {kind}, hash long, fp long")


def _segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, SHIFTS[i % 5]).bitwiseAND(F.lit((1 << WIDTHS[i % 5]) - 1))


def ring_keys(fp: Column) -> Column:
    """The ten join keys of a fingerprint: chain start i (5) and whether segment i+2 or i+3 is the third equal one."""
    keys = []
    for i in range(5):
        for third in (2, 3):
            key = F.lit(2 * i + third - 2)
            for k in (i, i + 1, i + third):
                key = F.shiftleft(key.cast("long"), 13).bitwiseOR(_segment(fp, k))
            keys.append(key)
    return F.array(*keys)


def _chain(i: Column, a: Column, b: Column) -> Column:
    """Whether the chain from segment i keeps within its budgets of floor(2k/5) differences."""
    x = a.bitwiseXOR(b)
    turned = F.lit(False)
    for start in range(5):
        total, ok = F.lit(0), F.lit(True)
        for k in range(1, 5):
            total = total + F.bit_count(_segment(x, start + k - 1))
            ok = ok & (total <= BUDGET * k // 5)
        turned = F.when(i == start, ok).otherwise(turned)
    return turned


def links(fps: DataFrame) -> DataFrame:
    """(u, v) with u < v: the pairs of distinct fingerprints ``fp`` of the rows that differ in at most two bits."""
    keyed = fps.select("fp").distinct().select("fp", F.explode(ring_keys(F.col("fp"))).alias("ring"))
    a, b = keyed.select("ring", F.col("fp").alias("u")), keyed.select("ring", F.col("fp").alias("v"))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= BUDGET
    start = F.shiftrightunsigned("ring", 40)
    pairs = a.join(b, "ring").where("u < v").where(_chain(start, F.col("u"), F.col("v"))).where(near)
    return pairs.select("u", "v").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(key, fingerprint string, component_id) for each row of ``docs``.

    component_id is the smallest key reachable over links, the row itself included; null keys count only if there is
    no other. Null, empty and wordless texts share fingerprint zero and link like any others. Repeated rows stay, and
    other columns of ``docs`` play no part.
    """
    fps = cut(fingerprint(docs, key, text, width))
    return grouped(fps, links(fps), key)


def rooted(fps: DataFrame, linked: DataFrame) -> DataFrame:
    """(fp, root) of the distinct fingerprints of the rows ``fps``, linked by ``linked`` (u, v): the least that each reaches."""
    found = components(linked)
    of = fps.select("fp").distinct().join(found, F.col("fp") == F.col("node"), "left")
    return of.select("fp", F.coalesce("root", "fp").alias("root"))


def grouped(fps: DataFrame, linked: DataFrame, key: str) -> DataFrame:
    """(key, fingerprint string, component_id) of rows (key, fp) whose fingerprints are linked by ``linked`` (u, v)."""
    of = fps.groupBy("fp").agg(F.min("key").alias("least")).join(rooted(fps, linked), "fp")
    named = of.join(of.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    out = fps.join(named, "fp", "left")
    return out.select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay when one row of each component does: see ``stay``."""
    fps = cut(fingerprint(docs, key, text, width))
    return stay(docs, fps, links(fps), key, text)


def stay(docs: DataFrame, fps: DataFrame, linked: DataFrame, key: str, text: str) -> DataFrame:
    """One row of ``docs`` for each component of the rows ``fps`` (key, hash of the text, fp) linked by ``linked``.

    The row of the smallest key stays, null keys last; of equal keys that of the least hash of the text; of rows equal in
    both, which are one document repeated, the first as JSON. Rows of one key with other texts are documents each.
    """
    of = fps.join(rooted(fps, linked), "fp").groupBy("root").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "hash")).alias("kept"))
    kept = cut(of.select(F.col("kept.key").alias("kept key"), F.col("kept.hash").alias("kept hash")))
    own, k = hidden(docs).withColumn("own hash", F.xxhash64(place_of(docs, text))), place_of(docs, key)
    rest = own.join(kept, F.col(k).eqNullSafe(F.col("kept key")) & (F.col("own hash") == F.col("kept hash")), "left_semi")
    twice = fps.groupBy("key", "hash").count().where("count > 1")
    if not twice.isEmpty():
        row = F.struct(*[f"c{i}" for i in range(len(docs.columns))])
        rest = rest.groupBy(k, "own hash").agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return rest.select(*[f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)
