"""Grammars, approximate neighbours, ids and tensors."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from factloom.functions import scalar
from factloom.operators import grammar as g
from factloom.operators import vectors
from factloom.queries.registry import query, table


@query("SELECT event_id::VARCHAR AS doc, '{\"key\": ' || (json_extract(props, '$.k')::BIGINT + 1) || '}' AS image, 0 AS problems FROM events")
def x13_construction_grammar(spark, d):
    """Each event's properties have one cover: an object of one number."""
    number = g.Construction("number", lambda n, c: isinstance(n, str), (), lambda i: int(i.node) + 1)
    record = g.Construction("record", lambda n, c: isinstance(n, dict), (g.Constituent(g.Field("k"), g.Child("number")),), lambda i: {"key": i.parts[0][0]})
    got = g.cover_documents(table(spark, d, "events"), F.col("event_id"), F.col("props"), g.Grammar([number, record]), "record")
    return got.select("doc", "image", F.size("findings").alias("problems"))


def _vectors(spark, d):
    t = table(spark, d, "embeddings").select(F.col("vec_id").alias("handle"), F.col("embedding").alias("vec"))
    return t, t.where("handle % 20 = 0").select(F.col("handle").alias("query"), "vec")


@query(None)
def v4_approximate_neighbours(spark, d):
    """Ten neighbours of each query row by codes; no SQL, since some are missed: v4_recall compares them."""
    t, q = _vectors(spark, d)
    return vectors.approximate_top_k(q, t, 10, 64, tables=20, bits=4).select("query", F.col("handle").alias("vec_id"), "cosine")


@query("SELECT count(*) * 10 AS asked, true AS recall_of_nine_tenths FROM embeddings WHERE vec_id % 20 = 0")
def v4_recall(spark, d):
    """How many of the ten nearest, found exactly, the codes give: nine tenths at least."""
    t, q = _vectors(spark, d)
    exact = vectors.top_k_per_query(q, t, 10).select("query", "handle")
    near = v4_approximate_neighbours(spark, d).select("query", F.col("vec_id").alias("handle"), F.lit(1).alias("hit"))
    both = exact.join(near, ["query", "handle"], "left").agg(F.count("*").alias("asked"), F.count("hit").alias("found"))
    return both.select("asked", (F.col("found") >= 0.9 * F.col("asked")).alias("recall_of_nine_tenths"))


@query("SELECT vec_id AS k, embedding[2 * 16 + 5 + 1]::DOUBLE AS x, NULL::DOUBLE AS outside FROM embeddings")
def f25_tensors(spark, d):
    t = table(spark, d, "embeddings")
    x = scalar.tensor(F.array(F.lit(4).cast("bigint"), F.lit(16).cast("bigint")), F.col("embedding"))
    return t.select(F.col("vec_id").alias("k"), scalar.tensor_at(x, 2, 5).cast("double").alias("x"), scalar.tensor_at(x, 4, 0).cast("double").alias("outside"))


_MASK = hashlib.sha256(b"events").hexdigest()


@query(f"SELECT event_id AS k, printf('%08x', (epoch_us(ts) // 1000) % 4294967296) || substr(sha256(event_id::VARCHAR), 1, 24) AS timed, '{_MASK[:16]}' || printf('%016x', xor(event_id, {int(_MASK[16:32], 16) - (1 << 63)}::BIGINT)) AS counted FROM events")
def f23_ids(spark, d):
    t = table(spark, d, "events")
    return t.select(F.col("event_id").alias("k"), scalar.time_prefixed_id(F.col("ts").cast("timestamp"), F.col("event_id")).alias("timed"), scalar.counter_id("events", F.col("event_id")).alias("counted"))
