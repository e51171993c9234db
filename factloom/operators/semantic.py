"""Search by meaning: a caller's encoder makes vectors of contents, which are then compared."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.codec import encoding
from factloom.operators import vectors
from factloom.sources.facts import FactSource

Encoder = Callable[[Column], Column]


def letters(text: Column) -> Column:
    """A plain encoder of texts: how often each letter from a to z stands in them."""
    low = F.lower(text)
    return F.transform(F.array(*[F.lit(chr(97 + i)) for i in range(26)]), lambda c: (F.length(low) - F.length(F.replace(low, c, F.lit("")))).cast("double"))


@dataclass(frozen=True)
class SemanticIndex:
    """rows (handle, vec), and the encoder, which may be an expression or a pandas function. Equal contents are encoded
    once; contents that the encoder gives null for aren't found."""

    rows: DataFrame
    encoder: Encoder

    @staticmethod
    def build(contents: DataFrame, key: str, content: str, encoder: Encoder) -> "SemanticIndex":
        rows = contents.where(F.col(key).isNotNull() & F.col(content).isNotNull()).select(F.col(key).alias("handle"), F.col(content).alias("content"))
        made = rows.select("content").distinct().select("content", encoder(F.col("content")).alias("vec")).where("vec is not null")
        return SemanticIndex(rows.join(made, "content").select("handle", "vec"), encoder)

    @staticmethod
    def from_facts(source: FactSource, attribute: str, encoder: Encoder) -> "SemanticIndex":
        rows = source.scan(attribute).select("e", encoding("text").decode(F.col("v")).alias("t"))
        return SemanticIndex.build(rows, "e", "t", encoder)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query, rank, handle, cosine) of the k nearest contents of each row of ``queries`` (query, content)."""
        asked = queries.select("query", self.encoder(F.col("content")).alias("vec")).where("vec is not null")
        return vectors.top_k_per_query(asked, self.rows, k)
