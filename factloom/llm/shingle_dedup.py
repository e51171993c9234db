"""Near copies by SimHash fingerprints of shingle sets, completed by their exact Jaccard similarity.

Two texts link if their sets of five-word shingles have a Jaccard similarity of 0.8 or more. First the SimHash fingerprints
of the sets are joined by the pigeonring (``simhash_dedup``): a set is compared in full with the least one whose
fingerprint is within two bits of its own. At a similarity of 0.8 two fingerprints differ in about ten bits, so that alone
would lose links; those between groups that the fingerprints didn't connect are found by an exact join, by prefix
filtering (Chaudhuri, Ganti and Kaushik, 2006): with all sets in one order, two similar sets share one of their first
n - ceil(0.8 n) + 1 shingles. Their lengths, and how many of these first ones they share, bound what two sets can have in
common: of the two, the one whose first ones end earlier shares no other shingle but those behind. The pairs left are
compared in full.

Links within a group of many copies are not all tried, only as many as connect it. Any order gives the same groups. The shingles that a sample of texts shows to be frequent come last, so that few sets meet
in a shingle. Equal sets are one node; shingles and sets are known by their XXH64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import cut, text_parts
from factloom.llm.graph import components
from factloom.llm.simhash_dedup import SEED, grouped, hash_parts, simhash_of, stay
from factloom.llm.simhash_dedup import links as ring_links

WIDTH = 5
#: The least similarity as a fraction.
OVER, UNDER = 4, 5
#: Texts of which frequent shingles are learnt, the least of them that hold a frequent one, and how many are told apart.
SAMPLE = 10_000
FREQUENT = 3
MOST = 100_000
#: Rows of one number at most that are broadcast; more are joined by it.
BROADCAST_ROWS = 500_000


def shingle_set(text: memoryview | bytes, width: int = WIDTH) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    parts = [np.unique(h) for h in hash_parts(text, width)]
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]))


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    for _, _, data, offsets in text_parts(batch, "text"):
        o = offsets.tolist()
        for s, e in zip(o, o[1:]):
            yield shingle_set(data[s:e], width)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *arrays]).view(np.int64)))


def _node(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def _nodes(sets: list[np.ndarray]) -> pa.Array:
    return pa.array(np.array([_node(h) for h in sets], dtype=np.uint64).view(np.int64))


def frequent(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of a sample of the rows (text), ascending, and on how many of its texts each is."""
    share = max(1, texts.count() // SAMPLE)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for h in _sets(b, width):
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

    of = texts.where(F.pmod(F.xxhash64(*texts.columns), F.lit(share)) == 0).select("text").distinct().mapInArrow(run, "h long")
    rows = of.groupBy("h").count().where(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "h").limit(MOST).collect()
    h = np.array([r["h"] for r in rows], dtype=np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], np.array([r["count"] for r in rows], dtype=np.int64)[order]


def prefix(hashes: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles of a set that any set similar to it shares one of, in the common order."""
    n = len(hashes)
    if not n:
        return hashes
    p = n - -(-OVER * n // UNDER) + 1
    at = np.searchsorted(known, hashes)
    at[at == len(known)] = 0
    often = np.where(known[at] == hashes, counts[at], 0) if len(known) else np.zeros(n, dtype=np.int64)
    return hashes[np.lexsort((hashes, often))][:p]


def _small(df: DataFrame) -> DataFrame:
    """Rows of one number, to be broadcast unless they are too many."""
    got = cut(df)
    return F.broadcast(got) if got.count() <= BROADCAST_ROWS else got


def links(docs: DataFrame, sets: DataFrame, width: int) -> DataFrame:
    """(u, v): similar nodes of the rows ``sets`` (key, hash of the text, fp, n, simhash, prefix) of ``docs`` (key, text), such
    that all similar nodes are connected.

    Of the copies of one text each shares its first shingles with every other, so the pairs are not all tried. In a first
    pass a node is compared with one other whose fingerprint is near; in a second, if that didn't connect them, with the
    least node of half of its first shingles or more; in the third, the pairs that share a shingle and that are still not
    connected."""
    full, twice = sets.where("n > 0"), _small(sets.groupBy("fp").count().where("count > 1").select("fp"))
    once = full.join(twice, "fp", "left_anti").unionByName(full.join(twice, "fp", "left_semi").dropDuplicates(["fp"])).select("fp", "n", F.explode("prefix").alias("h"))
    of = Window.partitionBy("h")
    shared = cut(once.select("h", "fp", "n", F.min("fp").over(of).alias("least"), F.max("fp").over(of).alias("most")).where("least < most").drop("most"))
    near = cut(_similar(docs, sets, cut(ring_pairs(full)), width))
    of = cut(components(near)).toDF("fp", "root")
    joined = shared.where("fp <> least").groupBy("fp", "least", "n").count().join(of, "fp", "left")
    joined = joined.join(of.toDF("least", "least root"), "least", "left")
    votes = joined.where(F.coalesce("root", "fp") != F.coalesce("least root", "least")).drop("root", "least root")
    many = 2 * F.col("count") > F.col("n") - F.floor((OVER * F.col("n") + UNDER - 1) / UNDER)
    first = votes.where(many).groupBy("fp").agg(F.max_by("least", F.struct("count", "least")).alias("v")).select(F.col("fp").alias("u"), "v")
    one = cut(near.unionByName(_similar(docs, sets, cut(first), width)))
    named = shared.drop("least").join(components(one).toDF("fp", "root"), "fp", "left").select("h", "fp", "n", F.coalesce("root", "fp").alias("c"))
    mixed = named.groupBy("h").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("h")
    rest = cut(named.join(mixed, "h", "left_semi"))
    a, b = rest.alias("a"), rest.alias("b")
    met = a.join(b, F.col("a.h") == F.col("b.h")).where("a.fp < b.fp and a.c <> b.c").where(UNDER * F.least("a.n", "b.n") >= OVER * F.greatest("a.n", "b.n"))
    met = met.groupBy(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"), F.col("a.n").alias("nu"), F.col("b.n").alias("nv")).count()
    behind = F.floor((OVER * F.greatest("nu", "nv") + UNDER - 1) / UNDER) - 1
    pairs = cut(met.where((OVER + UNDER) * (F.col("count") + behind) >= OVER * (F.col("nu") + F.col("nv"))).select("u", "v"))
    return one.unionByName(_similar(docs, sets, pairs, width))


def ring_pairs(sets: DataFrame) -> DataFrame:
    """(u, v): each node of the rows ``sets`` (fp, simhash) with the least node of those whose fingerprint is within two bits
    of its own, unless it is that itself."""
    least = cut(sets.groupBy(F.col("simhash").alias("s")).agg(F.min("fp").alias("v")))
    linked = ring_links(least.select(F.col("s").alias("fp")))
    both = linked.unionByName(linked.select(F.col("v").alias("u"), F.col("u").alias("v"))).toDF("s", "t")
    other = both.join(least.toDF("t", "v"), "t").select("s", "v").unionByName(least).groupBy("s").agg(F.min("v").alias("v"))
    return sets.select(F.col("fp").alias("u"), "simhash").distinct().join(other, F.col("simhash") == F.col("s")).where("u <> v").select("u", "v")


def _similar(docs: DataFrame, sets: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """The pairs (u, v) of nodes whose sets are similar, compared in full. Of each node one text goes to its pairs."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            last, x = None, None
            keep = []
            for i, (u, t, other) in enumerate(zip(b.column("u").to_pylist(), b.column("x"), b.column("y"))):
                if last is None or u != last:
                    last, x = u, shingle_set(t.as_buffer().to_pybytes(), width)
                y = shingle_set(other.as_buffer().to_pybytes(), width)
                if (OVER + UNDER) * len(np.intersect1d(x, y, assume_unique=True)) >= OVER * (len(x) + len(y)):
                    keep.append(i)
            yield b.select(["u", "v"]).take(pa.array(keep, pa.int64()))

    nodes = pairs.select(F.explode(F.array("u", "v")).alias("fp")).distinct()
    least = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "hash")).alias("one")
    chosen = _small(sets.select("fp", "key", "hash").join(nodes, "fp", "left_semi").groupBy("fp").agg(least).select("fp", F.col("one.key").alias("of key"), F.col("one.hash").alias("of hash")))
    texts = docs.withColumn("hash", F.xxhash64("text")).join(chosen, F.col("key").eqNullSafe(F.col("of key")) & (F.col("hash") == F.col("of hash"))).select("fp", "text")
    half = pairs.join(texts, F.col("u") == F.col("fp")).select("u", "v", F.col("text").alias("x"))
    both = half.join(texts, F.col("v") == F.col("fp")).select("u", "v", "x", F.col("text").alias("y"))
    return both.mapInArrow(run, "u long, v long").distinct()  # a repeated row repeats its pairs


def _sets_of(docs: DataFrame, key: str, text: str, width: int) -> tuple[DataFrame, DataFrame]:
    """The rows (key, text), and (key, hash of the text, fp, n, simhash, prefix) of their shingle sets."""
    base = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    known, counts = frequent(base, width)
    shared = docs.sparkSession.sparkContext.broadcast((known, counts))
    kind = base.schema["key"].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            got = list(_sets(b, width))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("hash"), _nodes(got), pa.array(list(map(len, got)), pa.int32()), pa.array(np.array([simhash_of([h]) for h in got], dtype=np.uint64).view(np.int64)), _lists([prefix(h, *shared.value) for h in got])], names=["key", "hash", "fp", "n", "simhash", "prefix"])

    hashed = base.withColumn("hash", F.xxhash64("text"))
    return base, cut(hashed.mapInArrow(run, f"key {kind}, hash long, fp long, n int, simhash long, prefix array<long>"))


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(key, fingerprint string, component_id) for each row of ``docs``; the fingerprint is that of its shingle set.

    component_id is as in ``simhash_dedup.near_duplicates``. Texts of fewer words than ``width`` have them all as their one
    shingle; null, empty and wordless texts are one node.
    """
    base, sets = _sets_of(docs, key, text, width)
    return grouped(sets.select("key", "fp"), links(base, sets, width), key)


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` that stay when one row of each group of near copies does: see ``simhash_dedup.stay``."""
    base, sets = _sets_of(docs, key, text, width)
    return stay(docs, sets.select("key", "hash", "fp"), links(base, sets, width), key, text)
