"""Exact top-k by inner product, term at a time.

A dimension is a term: its postings are the candidates with a component other than 0 there, with the weight. For each
component of a query row, the postings of its dimension, times the component, are added into a dense array of scores of
a block of candidates. The k best of each block are selected by a partition of the array, and merged over the blocks.

Queries and candidates are cut into blocks of at most ``BLOCK`` rows, and each pair of blocks is a task; what a task
holds is bounded, and so is what is shuffled: each row once for each block of the other side.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of queries or candidates at most, about.
BLOCK = 65_536
#: Blocks of candidates at least, so that small inputs are spread as well.
SPREAD = 12
_TILE = 64


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, x as double; null for a vector that is null or holds null or non-finite ones."""
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(x, lambda v: F.floor(v * scale)))


def best_of(queries: list[np.ndarray], ids: np.ndarray, query_ids: np.ndarray, candidates: list[np.ndarray], k: int) -> tuple[np.ndarray, ...]:
    """(query id, candidate id, score) of the k best candidates of each query; ``ids`` are the candidates', ascending."""
    n = len(ids)
    lengths = np.array([len(c) for c in candidates])
    values = np.concatenate(candidates) if n else np.zeros(0, dtype=np.int64)
    owner = np.repeat(np.arange(n), lengths)
    term = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    some = values != 0
    order = np.argsort(term[some], kind="stable")
    term, owner, values = term[some][order], owner[some][order], values[some][order]
    dims = int(term[-1]) + 1 if len(term) else 0
    edge = np.searchsorted(term, np.arange(dims + 1))
    wide = max([1, *(len(q) for q in queries)])
    most = float(np.abs(values).max(initial=0)) * max([0.0, *(float(np.abs(q).max(initial=0)) for q in queries)]) * wide
    kind = np.int32 if most < 2**31 else np.int64
    out: list[tuple[np.ndarray, ...]] = []
    for at in range(0, len(queries), _TILE):
        tile = queries[at : at + _TILE]
        scores = np.zeros((len(tile), n), dtype=kind)
        for d in range(min(dims, wide)):
            posts, weights = owner[edge[d] : edge[d + 1]], values[edge[d] : edge[d + 1]].astype(kind)
            rows = [i for i, q in enumerate(tile) if len(q) > d and q[d]]
            if not rows or not len(posts):
                continue
            q = np.array([tile[i][d] for i in rows], dtype=kind)
            if len(posts) == n and len(rows) == len(tile):
                scores += np.multiply.outer(q, weights)
            else:
                scores[np.ix_(rows, posts)] += np.multiply.outer(q, weights)
        for i, row in enumerate(scores):
            other = ids != query_ids[at + i]
            mine, names = row[other], ids[other]
            if len(mine) > k:
                least = np.partition(mine, len(mine) - k)[len(mine) - k]
                keep = np.flatnonzero(mine >= least)
                mine, names = mine[keep], names[keep]
            top = np.argsort(-mine.astype(np.int64), kind="stable")[:k]  # ids ascend, so ties go to the smaller
            out.append((np.full(len(top), query_ids[at + i]), names[top], mine[top].astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, dtype=np.int64),) * 3


_FOUND = "query_id long, vec_id long, score long"


def top_k(vectors: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank int, vec_id, score): for each row for which ``queries`` holds, the k candidates of the highest
    integer inner product, all if there are fewer; ties go to the smaller id.

    Candidates are all rows but those of the query's id. Rows with a null id, a null vector, or null or non-finite
    components take no part; a component that a shorter vector lacks counts 0. Rows that repeat an id are candidates each;
    of equal rows of one query id, one asks. Other columns play no part. Vectors so wide that a score may not fit a long
    are an error, never a wrong score.
    """
    rows = vectors.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), quantised(F.col(vector), scale).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).where("v is not null")
    most = F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))
    n, asking, top, dims = rows.agg(F.count("*"), F.count_if("asks"), most, F.max(F.size("v"))).first()
    if n and dims and top is not None and top * top * dims >= 2.0**63:
        raise OverflowError(f"components of {top / scale:g} in {dims} dimensions: scores would not fit 64 bits")
    parts = max(math.ceil(n / BLOCK), min(SPREAD, max(1, n // 64)))
    groups = math.ceil(asking / BLOCK) or 1
    spread = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    left = rows.where("asks").dropDuplicates(["id", "v"]).select("id", "v", (spread % groups).cast("int").alias("g"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("p"))
    right = rows.select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), (F.shiftright(spread, 8) % parts).cast("int").alias("p"))

    def unpack(t: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
        t = t.sort_by("id").combine_chunks()
        v = t.column("v").combine_chunks()
        v = v.chunk(0) if isinstance(v, pa.ChunkedArray) else v
        ends = np.cumsum(v.value_lengths().to_numpy())[:-1] if len(v) else []
        return t.column("id").to_numpy(), np.split(v.flatten().to_numpy(), ends) if len(v) else []

    def task(q: pa.Table, c: pa.Table) -> pa.Table:
        qi, qv = unpack(q)
        ci, cv = unpack(c)
        found = best_of(qv, ci, qi, cv, k)
        return pa.table([pa.array(x, pa.int64()) for x in found], names=["query_id", "vec_id", "score"])

    found = left.groupBy("g", "p").cogroup(right.groupBy("g", "p")).applyInArrow(task, _FOUND)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", place.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
