"""Stores of blobs and records: in memory, in folders with generations, and of two parts.

A store has ``blobs()`` (handle, bytes, at) and ``records()`` (record, kind, body), and takes more of both; what it holds
never changes. A folder store appends Parquet. Its generations are folders: compaction writes a new one with what is kept,
its name is recorded last, and reclaiming deletes the older ones, so a reader finds a whole generation at any time.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.scalar import digest
from factloom.sources import blobs as b

BLOBS = "handle string, bytes binary, at timestamp"
RECORDS = "record string, kind string, body string"


def record_rows(df: DataFrame, kind: str, body: Column) -> DataFrame:
    """(record, kind, body): the id of a record follows from its kind and body, so equal ones are one."""
    rows = df.select(F.lit(kind).alias("kind"), body.cast("string").alias("body")).where("body is not null").distinct()
    return rows.select(F.sha2(F.concat("kind", F.lit("\x1f"), "body"), 256).alias("record"), "kind", "body")


@dataclass
class MemoryStore:
    """A store that lives as long as its DataFrames; nothing is written."""

    spark: SparkSession
    parts: list[DataFrame] = field(default_factory=list)
    notes: list[DataFrame] = field(default_factory=list)

    def put(self, contents: DataFrame, content: Column) -> None:
        self.parts.append(b.put(contents, content))

    def note(self, df: DataFrame, kind: str, body: Column) -> None:
        self.notes.append(record_rows(df, kind, body))

    def blobs(self) -> DataFrame:
        return b.union(*self.parts) if self.parts else self.spark.createDataFrame([], BLOBS)

    def records(self) -> DataFrame:
        out = self.spark.createDataFrame([], RECORDS)
        for n in self.notes:
            out = out.unionByName(n)
        return out.distinct()


@dataclass(frozen=True)
class Snapshot:
    """What a store held when it was captured: the files of its blobs. Later appends aren't seen."""

    spark: SparkSession
    files: tuple[str, ...]

    def blobs(self) -> DataFrame:
        return self.spark.read.schema(BLOBS).parquet(*self.files) if self.files else self.spark.createDataFrame([], BLOBS)


@dataclass(frozen=True)
class FolderStore:
    """An append-only store in a folder that all machines share."""

    spark: SparkSession
    path: str

    @staticmethod
    def create(spark: SparkSession, path: str) -> "FolderStore":
        store = FolderStore(spark, path)
        store._begin(0)
        return store

    def _begin(self, number: int) -> None:
        self.spark.createDataFrame([], BLOBS).write.mode("append").parquet(f"{self._root(number)}/blobs")
        self.spark.createDataFrame([], RECORDS).write.mode("append").parquet(f"{self._root(number)}/records")
        self.spark.range(number, number + 1).select(F.col("id").cast("int").alias("generation")).write.mode("append").parquet(f"{self.path}/generations")

    def _root(self, number: int) -> str:
        return f"{self.path}/generation-{number}"

    def generation(self) -> int:
        return self.spark.read.schema("generation int").parquet(f"{self.path}/generations").agg(F.max("generation")).first()[0]

    def put(self, contents: DataFrame, content: Column) -> None:
        """Appends the contents that aren't stored."""
        new = b.put(contents, content).join(self.blobs().select("handle"), "handle", "left_anti")
        new.select("handle", "bytes", "at").write.mode("append").parquet(f"{self._root(self.generation())}/blobs")

    def note(self, df: DataFrame, kind: str, body: Column) -> None:
        record_rows(df, kind, body).write.mode("append").parquet(f"{self._root(self.generation())}/records")

    def blobs(self) -> DataFrame:
        return self.spark.read.schema(BLOBS).parquet(f"{self._root(self.generation())}/blobs")

    def records(self) -> DataFrame:
        return self.spark.read.schema(RECORDS).parquet(f"{self._root(self.generation())}/records").distinct()

    def capture(self) -> Snapshot:
        return Snapshot(self.spark, tuple(sorted(self.blobs().inputFiles())))

    def subtract(self, other: "FolderStore | MemoryStore | HybridStore | Snapshot") -> DataFrame:
        """The blobs that the other store lacks."""
        return b.forget(self.blobs(), other.blobs().select("handle").distinct())

    def verify(self) -> DataFrame:
        """(handle, reason) of the blobs that aren't what their handle says, and of those stored again."""
        rows = self.blobs()
        bad = rows.where(F.coalesce(digest(F.col("bytes")) != F.col("handle"), F.lit(True))).select("handle", F.lit("content").alias("reason"))
        return bad.unionByName(rows.groupBy("handle").count().where("count > 1").select("handle", F.lit("repeated").alias("reason")))

    def compact(self, roots: DataFrame | None = None) -> int:
        """Writes a new generation of the whole blobs, once each; only those that the roots (one column) reach, if given."""
        number = self.generation() + 1
        good = self.blobs().where(digest(F.col("bytes")) == F.col("handle")).dropDuplicates(["handle"])
        kept = good if roots is None else b.get(good, b.reachable(good, roots))
        kept.write.mode("overwrite").parquet(f"{self._root(number)}/blobs")
        self.records().write.mode("overwrite").parquet(f"{self._root(number)}/records")
        self._begin(number)
        return number

    def reclaim(self) -> int:
        """Deletes all generations but the newest, and says how many went."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        gone, newest = 0, self.generation()
        for n in range(newest):
            p = jvm.org.apache.hadoop.fs.Path(self._root(n))
            gone += bool(p.getFileSystem(conf).delete(p, True))
        return gone


@dataclass(frozen=True)
class HybridStore:
    """Blobs in one store, records in another."""

    blob_store: MemoryStore | FolderStore
    record_store: MemoryStore | FolderStore

    def put(self, contents: DataFrame, content: Column) -> None:
        self.blob_store.put(contents, content)

    def note(self, df: DataFrame, kind: str, body: Column) -> None:
        self.record_store.note(df, kind, body)

    def blobs(self) -> DataFrame:
        return self.blob_store.blobs()

    def records(self) -> DataFrame:
        return self.record_store.records()
