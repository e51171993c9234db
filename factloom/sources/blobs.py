"""Content-addressed blobs: a DataFrame of handle, bytes and when they were put."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.scalar import digest
from factloom.operators.shared import cut


def put(contents: DataFrame, content: Column, at: Column | None = None) -> DataFrame:
    """(handle, bytes, at), one row a content; texts are stored as UTF-8."""
    rows = contents.select(content.cast("binary").alias("bytes"), (at if at is not None else F.lit(None).cast("timestamp")).alias("at")).where("bytes is not null")
    return rows.groupBy(digest(F.col("bytes")).alias("handle")).agg(F.any_value("bytes").alias("bytes"), F.min("at").alias("at"))


def union(*stores: DataFrame) -> DataFrame:
    out = stores[0]
    for s in stores[1:]:
        out = out.unionByName(s)
    return out.groupBy("handle").agg(F.any_value("bytes").alias("bytes"), F.min("at").alias("at"))


def get(store: DataFrame, handles: DataFrame) -> DataFrame:
    """The blobs of the handles (one column) that the store has."""
    return store.join(handles.toDF("handle").distinct(), "handle", "left_semi")


def text(store: DataFrame) -> DataFrame:
    """(handle, text) of the blobs that are UTF-8."""
    return store.select("handle", F.try_validate_utf8(F.col("bytes").cast("string")).alias("text")).where("text is not null")


def metadata(store: DataFrame) -> DataFrame:
    return store.select("handle", F.octet_length("bytes").cast("bigint").alias("length"), "at")


def forget(store: DataFrame, handles: DataFrame) -> DataFrame:
    return store.join(handles.toDF("handle"), "handle", "left_anti")


keep = get


def children(store: DataFrame) -> DataFrame:
    """(parent, child): stored handles whose 32 bytes stand in a blob at a multiple of 32."""
    count = F.floor(F.octet_length("bytes") / 32).cast("int")
    at = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    chunks = store.select(F.col("handle").alias("parent"), "bytes", F.explode(at).alias("i"))
    chunks = chunks.select("parent", F.lower(F.hex(F.expr("substring(bytes, (i - 1) * 32 + 1, 32)"))).alias("child")).distinct()
    return chunks.join(store.select(F.col("handle").alias("child")), "child", "left_semi").select("parent", "child")


def reachable(store: DataFrame, roots: DataFrame) -> DataFrame:
    """Handles that the roots (one column) reach, themselves included if stored: what a collection must keep."""
    links = cut(children(store))
    seen = new = cut(get(store, roots).select("handle"))
    while not new.isEmpty():
        step = links.join(new.withColumnRenamed("handle", "parent"), "parent").select(F.col("child").alias("handle")).distinct()
        new = cut(step.join(seen, "handle", "left_anti"))
        seen = cut(seen.unionByName(new))
    return seen


def bundle(store: DataFrame, root: str | DataFrame) -> DataFrame:
    """The root's blob, or those of the roots (one column), and all that it reaches."""
    roots = root.toDF("handle") if isinstance(root, DataFrame) else store.where(F.col("handle") == root).select("handle")
    return get(store, reachable(store, roots))
