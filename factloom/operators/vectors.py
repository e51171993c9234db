"""Exact cosine similarity over vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.nearest import nearest


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    """The vector over its length; a zero vector stays as it is."""
    def over(n: Column) -> Column:
        return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))

    return F.get(F.transform(F.array(norm(a)), over), F.lit(0))  # the length is bound, not computed for each component


def cosine(a: Column, b: Column) -> Column:
    """Cosine within [-1, 1]; 0 where a vector is zero; null where the lengths differ."""
    n = norm(a) * norm(b)
    value = F.when(n > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / n))).otherwise(F.lit(0.0))
    return F.when(F.size(a) == F.size(b), value)


def _lit(query: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in query])


def _check(query: Sequence[float] | None, floor: float) -> None:
    if floor != floor or (query is not None and any(x != x for x in query)):
        raise ValueError("NaN in a similarity query")


def similar_to(vectors: DataFrame, query: Sequence[float], floor: float, key: str = "handle", vector: str = "vec") -> DataFrame:
    """(key, cosine) with cosine at least ``floor``, one row a key, the greatest of its rows; a scan without a shuffle
    but for the keys that pass."""
    _check(query, floor)
    hits = vectors.select(key, cosine(F.col(vector), _lit(query)).alias("cosine")).where(F.col("cosine") >= floor)
    return hits.groupBy(key).agg(F.max("cosine").alias("cosine"))


def top_k(vectors: DataFrame, query: Sequence[float], k: int, key: str = "handle", vector: str = "vec") -> DataFrame:
    """The k most similar, ties by key, one row a key; each task keeps k rows before they meet."""
    _check(query, 0.0)
    return similar_to(vectors, query, -2.0, key, vector).orderBy(F.desc("cosine"), key).limit(k)


def similar_to_key(vectors: DataFrame, handle: object, floor: float, key: str = "handle", vector: str = "vec") -> DataFrame:
    """Neighbours of a stored vector, itself included."""
    got = vectors.where(F.col(key) == handle).select(vector).orderBy(vector).first()
    if got is None:
        return vectors.where("false").select(key, F.lit(0.0).alias("cosine"))
    return similar_to(vectors, got[0], floor, key, vector)


def cosine_at_least(pairs: DataFrame, vectors: DataFrame, a: str, b: str, floor: float, key: str = "handle", vector: str = "vec") -> DataFrame:
    """Keeps the rows whose two bound keys have vectors of cosine at least ``floor``. It never proposes pairs itself."""
    _check(None, floor)
    one = vectors.select(F.col(key).alias(a), F.col(vector).alias("va"))
    two = vectors.select(F.col(key).alias(b), F.col(vector).alias("vb"))
    near = pairs.select(a, b).distinct().join(one, a).join(two, b).where(cosine(F.col("va"), F.col("vb")) >= floor).select(a, b).distinct()
    return pairs.join(near, [a, b], "left_semi")


def top_k_per_query(queries: DataFrame, vectors: DataFrame, k: int, key: str = "handle", vector: str = "vec") -> DataFrame:
    """(query, rank, key, cosine) for each row of ``queries`` (query, vec): all pairs, compared block by block (``nearest``)."""
    return nearest(queries, vectors, k, key, vector)


def hyperplane_codes(vector: Column, tables: int, bits: int, dims: int, seed: int = 1) -> Column:
    """An array of ``tables`` codes: the signs of ``bits`` random projections each. Signs of the planes are hash bits."""
    at = F.sequence(F.lit(0), F.lit(dims - 1))

    def of(t: int, signs: Column) -> Column:
        out = F.lit(0).cast("bigint")
        for b in range(bits):
            side = F.aggregate(F.zip_with(vector, signs, lambda x, h: F.when(F.shiftrightunsigned(h, b).bitwiseAND(F.lit(1)) == 1, x.cast("double")).otherwise(-x.cast("double"))), F.lit(0.0), lambda s, x: s + x)
            out = out + F.when(side >= 0, F.lit(1 << b)).otherwise(F.lit(0))
        return F.struct(F.lit(t).alias("table"), out.alias("code"))

    def code(t: int) -> Column:
        # the 64 bits of one hash a dimension give that dimension's sign in each of the table's planes; they are bound
        signs = F.transform(at, lambda i: F.xxhash64(F.lit(seed), F.lit(t), i))
        return F.get(F.transform(F.array(signs), lambda s: of(t, s)), F.lit(0))

    return F.array(*[code(t) for t in range(tables)])


def approximate_pairs(queries: DataFrame, vectors: DataFrame, floor: float, dims: int, key: str = "handle", vector: str = "vec", tables: int = 12, bits: int = 6) -> DataFrame:
    """(query, key, cosine) at least ``floor``, of the pairs that share the code of a table: an opt-in for inputs on which
    the exact scan is too long. What it gives is right, since cosines are computed; a pair may be missed, the more seldom
    the higher its cosine and the more tables there are."""
    _check(None, floor)
    q = queries.select("query", F.col("vec").alias("q"), F.explode(hyperplane_codes(F.col("vec"), tables, bits, dims)).alias("c")).select("query", "q", "c.*")
    v = vectors.select(key, vector, F.explode(hyperplane_codes(F.col(vector), tables, bits, dims)).alias("c")).select(key, vector, "c.*")
    near = q.join(v, ["table", "code"]).withColumn("cosine", cosine(F.col("q"), F.col(vector))).where(F.col("cosine") >= floor)
    return near.groupBy("query", key).agg(F.max("cosine").alias("cosine"))


def approximate_top_k(queries: DataFrame, vectors: DataFrame, k: int, dims: int, key: str = "handle", vector: str = "vec", tables: int = 12, bits: int = 6) -> DataFrame:
    """(query, rank, key, cosine): the k best of ``approximate_pairs`` without a floor, ties by key. Pairs are compared block
    by block, those that share a code as one product, and each block sends on k rows a query."""
    coded = lambda df, v, *more: df.select(*more, F.transform(hyperplane_codes(F.col(v), tables, bits, dims), lambda c: c["code"].cast("int")).alias("codes"))
    return nearest(coded(queries, "vec", "query", "vec"), coded(vectors, vector, key, vector), k, key, vector, codes=True)
