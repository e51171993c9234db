"""The canonical form of a set of facts: sorted rows of 64 bytes.

A row is 16 bytes of the entity, 16 of the attribute and 32 of the value; equal sets have equal bytes. Chunks hold up to
``CHUNK`` rows each and follow each other in order, so a large set is many values of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROW = 64
CHUNK = 4096


def id_hex(key: Column) -> Column:
    """16 bytes of an id, in hexadecimal: itself if it is written so, else the second half of its SHA-256."""
    return F.when(key.rlike(r"\A[0-9a-f]{32}\z"), key).otherwise(F.substring(F.sha2(key, 256), 33, 32))


def row_hex(facts: DataFrame) -> DataFrame:
    """(row): the distinct rows of facts (e, a, v), in hexadecimal."""
    return facts.select(F.concat(id_hex(F.col("e")), id_hex(F.col("a")), F.sha2("v", 256)).alias("row")).distinct()


def encode(facts: DataFrame) -> DataFrame:
    """(chunk, bytes): the canonical rows in chunks, numbered in the order of their rows."""
    placed = row_hex(facts).repartitionByRange("row").sortWithinPartitions("row").select("row", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i"))
    placed = placed.withColumn("c", F.floor((F.col("i") - F.shiftleft(F.col("p").cast("long"), 33)) / CHUNK))
    chunks = placed.groupBy("p", "c").agg(F.unhex(F.array_join(F.sort_array(F.collect_list("row")), "")).alias("bytes"))
    return chunks.select((F.shiftleft(F.col("p").cast("long"), 33) + F.col("c")).alias("chunk"), "bytes")


def decode(chunks: DataFrame) -> DataFrame:
    """(chunk, place, row): the rows of chunks, in hexadecimal; a last piece of fewer than 64 bytes is one too."""
    count = F.ceil(F.octet_length("bytes") / ROW).cast("int")
    at = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    rows = chunks.select("chunk", "bytes", F.explode(at).alias("place"))
    return rows.select("chunk", "place", F.lower(F.hex(F.expr(f"substring(bytes, place * {ROW} + 1, {ROW})"))).alias("row"))


def validate(chunks: DataFrame) -> DataFrame:
    """(chunk, place, reason) of the rows that break the form: short, out of order, repeated, of a nil entity or attribute."""
    rows = decode(chunks)
    before = F.lag("row").over(Window.partitionBy("chunk").orderBy("place"))  # at most CHUNK rows
    ends = rows.groupBy("chunk").agg(F.min("row").alias("least"), F.max("row").alias("most"))
    previous = ends.withColumn("previous", F.lag("most").over(Window.orderBy("chunk"))).select("chunk", "previous")  # a row a chunk
    seen = rows.withColumn("own", before).join(previous, "chunk").withColumn("before", F.coalesce("own", "previous"))
    nil = "0" * 32
    reason = F.when(F.length("row") < 2 * ROW, "short").when(F.substring("row", 1, 32) == nil, "nil entity").when(F.substring("row", 33, 32) == nil, "nil attribute").when(F.col("row") == F.col("before"), "repeated").when(F.col("row") < F.col("before"), "order")
    return seen.select("chunk", "place", reason.alias("reason")).where("reason is not null")
