"""Helpers that the training-data operators share: table access, lineage cuts and Arrow text buffers."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that a vectorised kernel handles at once; its temporaries are a few dozen times as large.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder and returns it with its lineage cut.

    The folder is the one that the cluster names in ``spark.checkpoint.dir``. Where none is set, one of this process is
    made in local mode, as in tests; on a cluster, whose machines don't share such a folder, that is an error.
    """
    sc = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def hidden(df: DataFrame) -> DataFrame:
    """``df`` with its columns named by their places, c0, c1 and so on, so that none clashes with an operator's own."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def place_of(df: DataFrame, column: str) -> str:
    """The name of a column of ``df`` in ``hidden(df)``."""
    names = [c.lower() for c in df.columns]
    return f"c{df.columns.index(column) if column in df.columns else names.index(column.lower())}"


def with_fields(df: DataFrame, fields: str) -> StructType:
    """The schema of ``df`` with the fields of a DDL string behind."""
    return StructType([*df.schema.fields, *StructType.fromDDL(fields).fields])


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the column's text form, modulo ``n``; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def lower_ascii() -> bytes:
    """Translation table of 256 bytes that lower-cases A-Z."""
    return bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def word_pieces(data: memoryview | bytes, ends: bytes, limit: int | None = None) -> Iterator[tuple[int, int]]:
    """Cuts a long text into pieces of about ``limit`` bytes behind one of the bytes ``ends``: (begin, end) of each. A
    piece without any of these bytes goes on to the next."""
    limit = CHUNK_BYTES if limit is None else limit
    at, n = 0, len(data)
    table = np.zeros(256, dtype=bool)
    table[list(ends)] = True
    while at < n:
        end = min(n, at + limit)
        while end < n:
            found = np.flatnonzero(table[np.frombuffer(data[end : end + 4096], dtype=np.uint8)])
            if len(found):
                end += int(found[0]) + 1
                break
            end = min(n, end + 4096)
        yield at, end
        at = end


def text_parts(batch: pa.RecordBatch, column: str, limit: int | None = None) -> Iterator[tuple[int, int, memoryview, np.ndarray]]:
    """Cuts a batch into runs of whole texts of about ``limit`` bytes (one text at least).

    Yields (first row, row after the last, UTF-8 bytes of the run, offsets of the texts in it). A null is empty.
    """
    limit = CHUNK_BYTES if limit is None else limit
    col = batch.column(column)
    if pa.types.is_large_string(col.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(col)
    if not n:
        return
    if col.null_count:
        col = col.fill_null("")
    buffers = col.buffers()
    offsets = np.frombuffer(buffers[1], dtype=kind, count=n + 1 + col.offset)[col.offset :].astype(np.int64)
    data = memoryview(buffers[2]) if buffers[2] is not None else memoryview(b"")
    row = 0
    while row < n:
        last = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        last = min(n, max(row + 1, last))
        yield row, last, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last

