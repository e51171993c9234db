"""Full-text ranking (BM25) over documents and text attributes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.codec import encoding
from factloom.functions.text import TOKENIZERS, bag
from factloom.operators.shared import cut
from factloom.sources.facts import FactSource

K1, B = 1.5, 0.75


@dataclass(frozen=True)
class Bm25:
    """postings (doc, term, tf) and lengths (doc, dl). A document may have no terms.

    Where each document is one row of a text table, its terms are counted within the row and nothing is shuffled: ``tokens``
    (doc, terms) are those rows. Where documents have several rows or segments, ``bags`` (doc, terms: (term, tf) sorted)
    has them all, which are shuffled once, by document; of a term the greatest frequency counts."""

    postings: DataFrame
    lengths: DataFrame
    k1: float = K1
    b: float = B
    tokens: DataFrame | None = None
    bags: DataFrame | None = None

    @staticmethod
    def build(docs: DataFrame, doc: str, text: str, tokenizer: str = "word", k1: float = K1, b: float = B, unique: bool | None = None) -> "Bm25":
        """A row's term frequency counts its occurrences; of rows of one document the greatest counts for each term. The
        length is the sum of the document's frequencies. ``unique``: whether each document is one row; None looks, by a
        job over the column of documents."""
        rows = docs.select(F.col(doc).alias("doc"), TOKENIZERS[tokenizer](F.col(text)).alias("terms")).where("doc is not null")
        bags = rows.select("doc", bag(F.col("terms")).alias("terms"))
        if unique is None:
            unique = docs.where(F.col(doc).isNotNull()).groupBy(doc).agg(F.count("*").alias("n")).where("n > 1").isEmpty()
        if not unique:
            return Bm25._of_bags(bags, k1, b)
        return Bm25(_inline(bags).where("term is not null"), rows.select("doc", F.size("terms").cast("bigint").alias("dl")), k1, b, rows, bags)

    @staticmethod
    def _of_bags(bags: DataFrame, k1: float, b: float) -> "Bm25":
        spread = _spread(bags)
        return Bm25(spread.where("term is not null"), spread.groupBy("doc").agg(_length()), k1, b, None, bags)

    @staticmethod
    def from_facts(source: FactSource, attribute: str, tokenizer: str = "word", **options: float) -> "Bm25":
        """Documents are the entities with a text value of the attribute."""
        rows = source.scan(attribute).select("e", encoding("text").decode(F.col("v")).alias("t")).where("t is not null")
        return Bm25.build(rows, "e", "t", tokenizer, **options)

    def merge(self, *others: "Bm25") -> "Bm25":
        """Union of segments: of a document and term in several the greatest frequency counts. In any order the same.
        Stored segments that share no document, which a job over their lengths finds out, are read as they are."""
        parts = (self, *others)
        if all(x.bags is not None for x in parts):
            return Bm25._of_bags(reduce(DataFrame.unionByName, [x.bags for x in parts]), self.k1, self.b)
        postings, lengths = (reduce(DataFrame.unionByName, x) for x in ([x.postings for x in parts], [x.lengths for x in parts]))
        if lengths.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            return Bm25(postings, lengths, self.k1, self.b)
        postings = postings.groupBy("doc", "term").agg(F.max("tf").alias("tf"))
        sizes = postings.select("doc", "tf").unionByName(lengths.select("doc", F.lit(0).cast("bigint").alias("tf")))
        return Bm25(postings, sizes.groupBy("doc").agg(F.sum("tf").alias("dl")), self.k1, self.b)

    def _frequencies(self, wanted: Sequence[str], *more: str) -> DataFrame:
        """(doc, dl, tfs) of every document, tfs in the order of ``wanted``, 0 for a term that it lacks; of tokens also the
        columns ``more``."""
        if self.tokens is not None:
            tfs = [(F.size("terms") - F.size(F.array_remove("terms", t))).cast("bigint") for t in wanted]
            return self.tokens.select("doc", *more, F.size("terms").cast("bigint").alias("dl"), F.array(*tfs).alias("tfs"))
        tfs = F.array(*[F.coalesce(F.max(F.when(F.col("term") == t, F.col("tf"))), F.lit(0).cast("bigint")) for t in wanted]).alias("tfs")
        if self.bags is not None:
            return _spread(self.bags).groupBy("doc").agg(_length(), tfs)
        hits = self.postings.where(F.col("term").isin(*wanted)).groupBy("doc").agg(tfs)
        none = F.array(*[F.lit(0).cast("bigint")] * len(wanted))
        return self.lengths.join(hits, "doc", "left").select("doc", "dl", F.coalesce("tfs", none).alias("tfs"))

    def write(self, path: str) -> None:
        """Stores the postings sorted by term, so that a query reads the row groups of its terms, and the lengths."""
        self.postings.repartitionByRange("term", "doc").sortWithinPartitions("term", "doc").write.mode("errorifexists").parquet(f"{path}/postings")
        self.lengths.write.mode("errorifexists").parquet(f"{path}/lengths")
        spark = self.postings.sparkSession
        spark.createDataFrame([(self.k1, self.b)], "k1 double, b double").write.mode("errorifexists").parquet(f"{path}/options")

    @staticmethod
    def read(spark: SparkSession, *paths: str) -> "Bm25":
        """The stored index, or the union of several: their scores are those of one index of all their documents."""
        parts = []
        for p in paths:
            options = spark.read.schema("k1 double, b double").parquet(f"{p}/options").first()
            parts.append(Bm25(spark.read.parquet(f"{p}/postings"), spark.read.parquet(f"{p}/lengths"), options["k1"], options["b"]))
        return parts[0].merge(*parts[1:]) if len(parts) > 1 else parts[0]

    def statistics(self) -> DataFrame:
        """One row: n_docs, avg_len."""
        return self.lengths.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_len"))

    def doc_frequency(self) -> DataFrame:
        return self.postings.groupBy("term").agg(F.count("*").alias("df"))

    def query(self, terms: Sequence[str]) -> DataFrame:
        """(doc, score) of the documents that hold a term; a term given twice counts twice. Order by score descending,
        then doc, for the ranked list."""
        wanted = list(dict.fromkeys(terms))
        if not wanted:
            return self.lengths.where("false").select("doc", F.lit(0.0).alias("score"))
        found = cut(self._frequencies(wanted))  # a few numbers a document, so that texts or postings are read once
        return _scored(found, found, terms, self.k1, self.b).where("score is not null").select("doc", "score")

    def query_text(self, text: str, tokenizer: str = "word") -> DataFrame:
        spark = self.postings.sparkSession
        terms = spark.range(1).select(TOKENIZERS[tokenizer](F.lit(text)).alias("t")).first()[0]
        return self.query(terms)

    def ranked(self, terms: Sequence[str], k: int | None = None) -> DataFrame:
        out = self.query(terms).orderBy(F.desc("score"), "doc")
        return out if k is None else out.limit(k)

    def matches(self, terms: Sequence[str], floor: float) -> DataFrame:
        """Documents whose score is at least ``floor``, to be used as a membership set."""
        return self.query(terms).where(F.col("score") >= floor).select("doc")

    def with_all(self, terms: Sequence[str]) -> DataFrame | None:
        """Documents that hold every term; None if there are no terms."""
        wanted = list(dict.fromkeys(terms))
        if not wanted:
            return None
        if self.tokens is not None:
            return self.tokens.where(reduce(lambda x, y: x & y, [F.array_contains("terms", t) for t in wanted])).select("doc")
        hits = self.postings.where(F.col("term").isin(*wanted))
        return hits.groupBy("doc").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("doc")

    def reconstruct(self) -> DataFrame:
        """(doc, terms): the sorted bag of each document's terms with their frequencies."""
        if self.tokens is not None:
            return self.bags.where(F.size("terms") > 0)
        return self.postings.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("term", "tf"))).alias("terms"))


def _length() -> Column:
    """Length of a document from its terms in ``_spread``."""
    return F.coalesce(F.sum("tf"), F.lit(0).cast("bigint")).alias("dl")


def _inline(bags: DataFrame) -> DataFrame:
    """(doc, term, tf); a document without terms has one row, of null. From an outer one no filter is inferred, which would
    find the terms a second time."""
    return bags.select("doc", F.inline_outer("terms"))


def _spread(bags: DataFrame) -> DataFrame:
    """``_inline`` with the greatest frequency of each document and term; what follows by document shuffles no more."""
    return _inline(bags.repartition("doc")).groupBy("doc", "term").agg(F.max("tf").alias("tf"))


def _scored(rows: DataFrame, found: DataFrame, terms: Sequence[str], k1: float, b: float) -> DataFrame:
    """``rows`` (dl, tfs, ...) with their score, null if they hold none of the terms; ``found`` (dl, tfs) has a row for each
    document. tfs are in the order of the distinct terms."""
    wanted = list(dict.fromkeys(terms))
    df = F.array(*[F.count_if(F.get("tfs", F.lit(i)) > 0) for i in range(len(wanted))])
    stats = found.agg(F.count("*").alias("__n"), F.avg("dl").alias("__avg"), df.alias("__df"))
    score, holds = F.lit(0.0), F.lit(False)
    for i, t in enumerate(wanted):
        tf, n = F.get("tfs", F.lit(i)), F.get("__df", F.lit(i))
        idf = F.log((F.col("__n") - n + 0.5) / (n + 0.5) + 1)
        norm = tf + k1 * (1 - b + b * F.col("dl") / F.nullif(F.col("__avg"), F.lit(0.0)))
        score = score + F.when(tf > 0, idf * tf * (k1 + 1) / norm * float(list(terms).count(t))).otherwise(0.0)
        holds = holds | (tf > 0)
    return rows.crossJoin(F.broadcast(stats)).withColumn("score", F.when(holds, score)).drop("__n", "__avg", "__df")  # one row


def substring_search(docs: DataFrame, doc: str, text: str, literal: str, index: Bm25 | None = None) -> DataFrame:
    """Documents whose text holds the literal. With a trigram index only its candidates are read; the text decides."""
    rows = docs
    if index is not None:
        spark = docs.sparkSession
        grams = spark.range(1).select(TOKENIZERS["trigram"](F.lit(literal)).alias("t")).first()[0]
        found = index.with_all(grams)
        if found is not None:
            rows = docs.join(found.withColumnRenamed("doc", doc), doc, "left_semi")
    return rows.where(F.contains(F.col(text), F.lit(literal))).select(doc)


def best_entities(source: FactSource, attribute: str, query: str, k: int, tokenizer: str = "word", snippet: int = 80) -> DataFrame:
    """(e, score, snippet): the k entities whose best text on the attribute scores highest. Each text is a document."""
    rows = source.scan(attribute).select("e", encoding("text").decode(F.col("v")).alias("t")).where("t is not null")
    spark = rows.sparkSession
    asked = spark.range(1).select(TOKENIZERS[tokenizer](F.lit(query)).alias("t")).first()[0]
    wanted = list(dict.fromkeys(asked))
    held = rows.select("e", F.sha2("t", 256).alias("h"), "t")
    terms = held.select("e", "h", TOKENIZERS[tokenizer](F.col("t")).alias("terms"))
    # a few numbers a text: the texts themselves are neither shuffled nor sorted
    thin = cut(Bm25(terms, terms, tokens=terms.withColumnRenamed("h", "doc"))._frequencies(wanted, "e")) if wanted else None
    if thin is None:
        return rows.where("false").select("e", F.lit(0.0).alias("score"), F.substring("t", 1, snippet).alias("snippet"))
    scores = cut(_scored(thin, thin.dropDuplicates(["doc"]), asked, K1, B).where("score is not null").groupBy("e", "doc").agg(F.max("score").alias("score")))
    top = cut(scores.groupBy("e").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "e").limit(k))
    # texts of these entities only; of several that score alike the greatest
    own = held.join(F.broadcast(top), "e").join(scores.join(F.broadcast(top), ["e", "score"], "left_semi").select("e", F.col("doc").alias("h")), ["e", "h"], "left_semi")
    best = own.groupBy("e").agg(F.max("score").alias("score"), F.max("t").alias("t"))
    return best.select("e", "score", F.substring("t", 1, snippet).alias("snippet")).orderBy(F.desc("score"), "e").limit(k)
