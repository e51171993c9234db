"""The k nearest vectors of each query by cosine, by products of matrices.

Queries and vectors are dealt to blocks of bounded size, and a task compares one block of each. Products in single precision
leave out what can't be among the k; what may be is computed again in double precision, in the order of the components,
as ``vectors.cosine`` does, so that results and ties are those of a plain scan. All pairs are compared, which is
quadratic, but no task holds more than its two blocks, and each sends on k rows a query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Components that a block holds, about; products that a task holds at once; tasks to be had, if there are rows for them.
SIDE, PRODUCTS, TASKS = 1 << 21, 1 << 22, 48
#: Parts of a row of products whose maxima bound its k-th greatest from below.
_PARTS = 128


class Side:
    """Vectors of one length: in double precision by component, and scaled to unit length in single precision."""

    def __init__(self, m: np.ndarray, gaps: np.ndarray | None = None) -> None:
        """``gaps``: rows that hold a null, whose cosine is 0."""
        self.gaps = np.zeros(len(m), bool) if gaps is None else gaps
        with np.errstate(all="ignore"):
            self.parts = np.ascontiguousarray(m.T)
            self.norm = np.zeros(len(m))
            for x in self.parts:
                self.norm += x * x
            self.norm = np.sqrt(self.norm)
            #: Rows whose products say nothing: not finite, or so long or short that squares were lost.
            self.odd = ~((self.norm == 0) | ((self.norm > 1e-100) & (self.norm < 1e100)))
            scale = np.where(self.odd | (self.norm == 0), 0, 1 / self.norm)
            self.unit = np.where(self.odd[:, None], 0, m * scale[:, None]).astype(np.float32)


def cosines(q: Side, i: np.ndarray, v: Side, j: np.ndarray) -> np.ndarray:
    """``vectors.cosine`` of the rows i of q with the rows j of v."""
    with np.errstate(all="ignore"):
        dot = np.zeros(len(i))
        for x, y in zip(q.parts, v.parts):
            dot += x[i] * y[j]
        n = q.norm[i] * v.norm[j]
        return np.where(((n > 0) | np.isnan(n)) & ~q.gaps[i] & ~v.gaps[j], np.fmax(-1.0, np.fmin(1.0, dot / n)), 0.0)


def first(i: np.ndarray, j: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k rows of each i with the greatest c, ties to the smaller j."""
    order = np.lexsort((j, -c, i))
    i, j, c = i[order], j[order], c[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[keep], j[keep], c[keep]


def best(q: Side, v: Side, k: int, at: np.ndarray | None = None, among: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, cosine) of the k best rows j of v for each row i of q, in parts; ``at`` and ``among``: only these rows."""
    at = np.arange(len(q.norm)) if at is None else at
    among = np.arange(len(v.norm)) if among is None else among
    n, dims = len(among), len(v.parts)
    if not n or not len(at) or k < 1:
        return
    unit, odd = v.unit[among].T, np.flatnonzero(v.odd[among])
    slack = np.float32(3e-7 * (dims + 8))  # twice what rounding may take from a product, and more
    step = max(1, PRODUCTS // max(n, 256))
    for lo in range(0, len(at), step):
        rows = at[lo : lo + step]
        s = q.unit[rows] @ unit
        s[:, odd] = -3
        width = n // _PARTS
        if n <= k:
            floor = np.full(len(rows), -4, np.float32)
        elif width > 1 and 2 * k <= _PARTS:
            tops = s[:, : width * _PARTS].reshape(len(rows), _PARTS, width).max(axis=2)
            floor = np.partition(tops, _PARTS - k, axis=1)[:, _PARTS - k]
        else:
            floor = np.partition(s, n - k, axis=1)[:, n - k]
        floor = np.where(q.odd[rows], np.float32(-4), floor) - slack
        s[:, odd] = 3
        i, j = np.nonzero(s >= floor[:, None])
        i, j = rows[i], among[j]
        yield first(i, j, cosines(q, i, v, j), k)


def sides(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, Side]]:
    """By length, the places of the vectors that aren't null, and the vectors."""
    whole = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    lengths = pc.fill_null(pc.list_value_length(whole), -1).to_numpy(zero_copy_only=False)
    offsets, values = whole.offsets.to_numpy(), whole.values
    x = values.to_numpy(zero_copy_only=False).astype(np.float64)
    gaps = values.is_null().to_numpy(zero_copy_only=False) if values.null_count else None
    out = {}
    for d in np.unique(lengths[lengths >= 0]).tolist():
        places = np.flatnonzero(lengths == d)
        at = offsets[places][:, None] + np.arange(d)
        m, null = x[at], None if gaps is None else gaps[at].any(axis=1)
        if null is not None:
            m[null] = 0
        out[d] = places, Side(m, null)
    return out


def _by_code(asked: pa.Table, held: pa.Table, a: tuple, b: tuple, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query among the vectors that share the code of a table with it, a key once."""
    codes = [np.array(t.column("codes").to_pylist(), dtype=np.int64).reshape(len(t), -1)[places] for t, (places, _) in ((asked, a), (held, b))]
    keys = pc.dictionary_encode(held.column("handle")).combine_chunks()
    keys = (pa.concat_arrays(keys.chunks) if isinstance(keys, pa.ChunkedArray) else keys).indices.fill_null(-1).to_numpy(zero_copy_only=False)[b[0]]
    more = int(np.unique(keys, return_counts=True)[1].max(initial=1))  # rows of one key
    found = []
    for t in range(codes[0].shape[1]):
        for code in np.intersect1d(codes[0][:, t], codes[1][:, t]).tolist():
            found += best(a[1], b[1], k * more, np.flatnonzero(codes[0][:, t] == code), np.flatnonzero(codes[1][:, t] == code))
    if not found:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    i, j, c = map(np.concatenate, zip(*found))
    order = np.lexsort((-c, keys[j], i))  # of a key its greatest
    i, j, c = i[order], j[order], c[order]
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] != i[:-1]) | (keys[j][1:] != keys[j][:-1])
    return first(i[new], j[new], c[new], k)


def tile(asked: pa.Table, held: pa.Table, k: int) -> pa.Table:
    """(query, handle, cosine) of the k best of ``held`` (handle, v, codes) for each of ``asked`` (query, q, codes), with codes only of
    those that share one. A cosine is null where the lengths differ; these come last, and not at all with codes."""
    held = held.take(pc.sort_indices(held, sort_keys=[("handle", "ascending")], null_placement="at_start"))
    coded = "codes" in asked.column_names
    a, b = sides(asked.column("q")), sides(held.column("v"))
    parts = []
    for d, (places, q) in a.items():
        if d in b:
            found = [_by_code(asked, held, a[d], b[d], k)] if coded else best(q, b[d][1], k)
            parts += [(places[i], b[d][0][j], c, np.zeros(len(i), bool)) for i, j, c in found]
    if not coded and (len(a) != 1 or len(b) != 1 or a.keys() != b.keys() or sum(len(x) for x, _ in a.values()) < len(asked) or sum(len(x) for x, _ in b.values()) < len(held)):
        nulls = [(d, places) for d, (places, _) in a.items()]
        nulls.append((-1, np.setdiff1d(np.arange(len(asked)), np.concatenate([p for _, p in nulls] or [np.empty(0, int)]))))
        for d, places in nulls:
            own = b[d][0] if d in b else np.empty(0, int)
            rest = np.setdiff1d(np.arange(len(held)), own)[: max(0, k - len(own))]
            n = len(places) * len(rest)
            parts.append((np.repeat(places, len(rest)), np.tile(rest, len(places)), np.zeros(n), np.ones(n, bool)))
    i, j, c, none = map(np.concatenate, zip(*parts)) if parts else (np.empty(0, int), np.empty(0, int), np.empty(0), np.empty(0, bool))
    return pa.table([asked.column("query").take(pa.array(i.astype(np.int64))), held.column("handle").take(pa.array(j.astype(np.int64))), pa.array(c, pa.float64(), mask=none)], names=["query", "handle", "cosine"])


def nearest(queries: DataFrame, vectors: DataFrame, k: int, key: str = "handle", vector: str = "vec", codes: bool = False, within: str | None = None) -> DataFrame:
    """(query, rank, key, cosine) of the k best of ``vectors`` (key, vector) for each row of ``queries`` (query, vec), ties by
    key. ``codes``: both have an array of numbers ``codes``, and only rows that share one at its place are compared; then a
    key is one row. ``within``: a column of both, a number; only rows that agree in it are compared, and it comes first."""
    q, v = queries, vectors
    n, d = v.agg(F.count("*"), F.max(F.size(vector))).first()
    side = max(64, SIDE // max(1, d or 1))
    blocks = max(1, math.ceil(q.count() / side))
    shards = max(1, math.ceil(n / side), min(math.ceil(TASKS / blocks), math.ceil(n / 1024)))
    more = ["codes"] * codes + [within] * (within is not None)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda c, n, seed: F.pmod(F.xxhash64(F.lit(seed), F.col(c)), F.lit(n)).cast("int")
    asked = q.select("query", F.col("vec").alias("q"), *more, dealt("query", blocks, 2).alias("__block")).select("*", every(shards).alias("__shard"))
    held = v.select(F.col(key).alias("handle"), F.col(vector).alias("v"), *more, dealt(key, shards, 3).alias("__shard")).select("*", every(blocks).alias("__block"))
    kinds = {"query": q.schema["query"].dataType.simpleString(), "handle": v.schema[key].dataType.simpleString()}
    out = f"query {kinds['query']}, handle {kinds['handle']}, cosine double"
    place = ["__shard", "__block"] + [within] * (within is not None)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        got = tile(a, b, k)
        return got if within is None else got.append_column(within, pa.array([a.column(within)[0].as_py() if len(a) else 0] * len(got), pa.int32()))

    found = asked.groupBy(*place).cogroup(held.groupBy(*place)).applyInArrow(run, out + (f", {within} int" if within is not None else ""))
    own = ["query"] + [within] * (within is not None)
    if codes:
        found = found.groupBy("query", "handle").agg(F.max("cosine").alias("cosine"))
    rank = F.row_number().over(Window.partitionBy(*own).orderBy(F.desc("cosine"), "handle"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(*own[1:], "query", "rank", F.col("handle").alias(key), "cosine")


#: Pairs that a task of ``pairs`` makes at once, about.
PAIRS = 1 << 20


def pairs(queries: DataFrame, vectors: DataFrame, columns: list[str], key: str = "handle") -> DataFrame:
    """(query, key, c0, c1, ...) of each row of ``queries`` (query, vec) with each key of ``vectors``: the cosines with its
    vectors in ``columns``, the greatest of the key's rows; null where lengths differ. As many rows as there are pairs."""
    n, d = vectors.agg(F.count("*"), F.max(F.size(columns[0]))).first()
    width = max(16, min(SIDE // max(1, d or 1), math.isqrt(PAIRS)))
    blocks, shards = max(1, math.ceil(queries.count() / width)), max(1, math.ceil(n / width))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda c, n, seed: F.pmod(F.xxhash64(F.lit(seed), F.col(c)), F.lit(n)).cast("int")
    asked = queries.select("query", F.col("vec").alias("q"), dealt("query", blocks, 2).alias("__block")).select("*", every(shards).alias("__shard"))
    named = [F.col(c).alias(f"v{i}") for i, c in enumerate(columns)]
    held = vectors.select(F.col(key).alias("handle"), *named, dealt(key, shards, 3).alias("__shard")).select("*", every(blocks).alias("__block"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.take(pc.sort_indices(b, sort_keys=[("handle", "ascending")]))
        keys = b.column("handle").combine_chunks()
        keys = pa.concat_arrays(keys.chunks) if isinstance(keys, pa.ChunkedArray) else keys
        number = pc.dictionary_encode(keys, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]]) if len(b) else np.empty(0, int)
        q, out = sides(a.column("q")), []
        for i in range(len(columns)):
            c = np.full((len(a), len(b)), -np.inf)  # no cosine
            for length, (places, v) in sides(b.column(f"v{i}")).items():
                if length in q:
                    at, x = q[length]
                    with np.errstate(all="ignore"):
                        norms = np.outer(x.norm, v.norm)
                        own = np.where(((norms > 0) | np.isnan(norms)) & ~x.gaps[:, None] & ~v.gaps, np.fmax(-1.0, np.fmin(1.0, (x.parts.T @ v.parts) / norms)), 0.0)
                    c[np.ix_(at, places)] = own
            c = np.maximum.reduceat(c, starts, axis=1).ravel() if len(starts) and len(a) else np.empty(0)
            out.append(pa.array(c, pa.float64(), mask=c < -1))
        names = [a.column("query").take(pa.array(np.repeat(np.arange(len(a)), len(starts)))), keys.take(pa.array(np.tile(starts, len(a))))]
        return pa.table([*names, *out], names=["query", "handle", *[f"c{i}" for i in range(len(columns))]])

    kinds = f"query {queries.schema['query'].dataType.simpleString()}, handle {vectors.schema[key].dataType.simpleString()}"
    found = asked.groupBy("__shard", "__block").cogroup(held.groupBy("__shard", "__block")).applyInArrow(run, kinds + "".join(f", c{i} double" for i in range(len(columns))))
    return found.withColumnRenamed("handle", key)
