"""Mixing of sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions alone.

Targets: sources share a total by weight; a source's target stops at ``MOST`` times its size, and the excess is shared
again by weight among the others until none is above. A source whose target is above its size is taken in complete
epochs first. The rest of the target is a weighted sample without replacement: each document has the exponential key
-ln(u) / quality, u a hash of its id and text, and the documents of the smallest keys are taken until their sizes reach
the rest. The quality weight is learnt from labels: texts fall into 64 cells by their share of digits and markup and their
mean word length, and a cell's weight is the share of good ones among its labelled texts, drawn towards that of all.

The prefix sums don't sort a source in one task. Keys are cut into ``BUCKETS`` buckets along their logarithm, so that keys
of any quality are spread (a factor of e holds 1,489 of them); the buckets' sizes are summed with partial sums, and show
for each source the bucket in which the rest runs out. Documents of earlier buckets are taken and those of later ones are
not; only the rows of that bucket, a few in ten thousand of a source, are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import cut, hidden, place_of

MOST = 3.0
BUCKETS = 1 << 16
#: Least and most of the logarithm of a key that are told apart.
LOG_KEYS = (-37.0, 7.0)
#: Sources at most whose targets, a row each, are broadcast; more are joined.
BROADCAST_SOURCES = 100_000
WEIGHTS = (5.0, 2.0, 1.0)
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """Quality weight in (0, 1]: the share of characters that are no digits or markup; 0.05 at least, also without text."""
    odd = F.length(text) - F.length(F.translate(text, "0123456789|_={}<>#*@/\\", ""))
    return F.greatest(F.lit(0.05), F.coalesce(1 - odd / F.nullif(F.length(text), F.lit(0)), F.lit(0.05)))


#: Bounds of a text's share of digits and markup, and of its mean word length: those passed number its cell.
_ODD, _LONG = (0.0, 0.005, 0.02, 0.05, 0.1, 0.2, 0.4), (2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 12.0)
#: Labelled texts that the share of all counts for in a cell.
PRIOR = 5.0
LEAST_QUALITY = 0.05


def cell(text: Column, size: Column) -> Column:
    """Number, from 0 to 63, of a text's cell; ``size`` is its number of words. A null or empty text is of cell 0."""
    odd = F.length(text) - F.length(F.translate(text, "0123456789|_={}<>#*@/\\$%&", ""))
    x, y = odd / F.nullif(F.length(text), F.lit(0)), F.length(text) / F.nullif(size, F.lit(0))
    passed = lambda v, bounds: sum(((v > b).cast("int") for b in bounds), F.lit(0))
    return F.coalesce(8 * passed(x, _ODD) + passed(y, _LONG), F.lit(0))


def learnt_quality(rows: DataFrame, labels: DataFrame, label_key: str, label: str) -> Column:
    """The quality weight of the rows' (key, cell): of labelled keys the share of good ones, by cell. A key labelled more
    than once has the mean; with no label at all the weight is 1. 64 rows come to the driver."""
    marks = labels.where(F.col(label).isNotNull() & F.col(label_key).isNotNull()).groupBy(F.col(label_key).alias("label key")).agg(F.avg(F.col(label).cast("double")).alias("good"))
    got = rows.select("key", "cell").join(marks, F.col("key") == F.col("label key")).groupBy("cell").agg(F.count("*").alias("n"), F.sum("good").alias("good")).collect()
    n, good = sum(r["n"] for r in got), sum(r["good"] for r in got)
    if not n:
        return F.lit(1.0)
    mean = good / n
    weights = {r["cell"]: (r["good"] + PRIOR * mean) / (r["n"] + PRIOR) for r in got}
    table = F.array(*[F.lit(float(min(1.0, max(LEAST_QUALITY, weights.get(c, mean))))) for c in range(64)])
    return F.element_at(table, F.col("cell") + 1)


def targets(sources: DataFrame, share: float = 1.0, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """Adds target to the rows (source, source_size), one a source: ``share`` of all sizes by the weights, which repeat
    along the sources by code point, null last. Only sums and counts come to the driver."""
    order = Window.orderBy(F.col("source").isNull(), "source")  # one row a source
    turn = (F.row_number().over(order) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), turn + 1)
    rows = cut(sources.withColumn("w", w).withColumn("top", F.col("source_size") * float(most)))
    total = (rows.agg(F.sum("source_size")).first()[0] or 0) * share
    level, full = 0.0, -1
    while True:  # sources above their tops at this level stop there; the level rises for the others
        above = F.col("w") * level > F.col("top") if full >= 0 else F.lit(False)
        spent, free, n = rows.agg(F.coalesce(F.sum(F.when(above, F.col("top"))), F.lit(0.0)), F.sum(F.when(~above, F.col("w"))), F.count_if(above)).first()
        if n == full or not free:
            break
        full, level = n, (total - spent) / free
    if full < 0:
        return rows.select("source", "source_size", F.lit(0.0).alias("target"))
    return rows.select("source", "source_size", F.least(F.col("w") * level, F.col("top")).alias("target"))


def sampled(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.0, weights: tuple[float, ...] = WEIGHTS, seed: int = 17, labels: DataFrame | None = None, label_key: str = "doc_id", label: str = "quality") -> DataFrame:
    """(key, text_hash, size, source, source_size, target, epochs, picked, taken) for each row of ``docs``.

    size: words of the text (null or wordless: 0, which is never picked or taken). epochs: complete passes over the
    source; picked: whether the sample of the rest holds the document; taken: size times both. The document at which the
    rest runs out is picked if that brings the sum nearer. Equal keys are ordered by id and text; rows that are equal in
    both are interchangeable, so that reruns agree. Without ``labels`` the quality weight is the share of characters that
    are no digits or markup. Columns of other names play no part.
    """
    return _sampled(docs, key, text, source, share, weights, seed, labels, label_key, label, False).withColumnRenamed("key", key)


def _sampled(docs: DataFrame, key: str, text: str, source: str, share: float, weights: tuple[float, ...], seed: int, labels: DataFrame | None, label_key: str, label: str, carry: bool) -> DataFrame:
    """What ``sampled`` gives, with key as ``key``, and with the columns of ``hidden(docs)`` if asked to carry them."""
    base = hidden(docs)
    own = base.columns if carry else []
    k, t, s = (F.col(place_of(docs, c)) for c in (key, text, source))
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), k, t), 11).cast("double") + 1) / float(1 << 53)
    rows = base.select(*own, k.alias("key"), F.xxhash64(t).alias("text_hash"), s.alias("source"), word_count(t).alias("size"), u.alias("u"), t.alias("t"))
    rows = rows.withColumn("quality", quality(F.col("t"))).withColumn("cell", cell(F.col("t"), F.col("size"))).drop("t")
    rows = cut(rows)  # the only pass over the texts
    weight = F.col("quality") if labels is None else learnt_quality(rows, labels, label_key, label)
    rows = rows.withColumn("k", -F.log("u") / weight).drop("u", "quality", "cell")
    low, high = LOG_KEYS
    level = F.floor((F.log("k") - low) * (BUCKETS / (high - low)))  # rises with k; the logarithm of 0 is null
    rows = rows.withColumn("bucket", F.coalesce(F.least(F.lit(BUCKETS - 1), F.greatest(F.lit(0), level)), F.lit(0)).cast("int"))
    sums = cut(rows.groupBy("source", "bucket").agg(F.sum("size").alias("size")))
    goals = targets(sums.groupBy("source").agg(F.sum("size").alias("source_size")), share, weights)
    goals = goals.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    goals = goals.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    prefix = sums.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))  # at most BUCKETS rows a source
    edge = prefix.alias("p").join(goals.alias("g"), F.col("p.source").eqNullSafe(F.col("g.source")))
    edge = edge.where("p.before <= g.rest").groupBy(F.col("g.source").alias("s")).agg(F.max("p.bucket").alias("edge"), F.max_by("p.before", "p.bucket").alias("edge_before"))
    goals = goals.join(edge, F.col("source").eqNullSafe(F.col("s")), "left").drop("s").withColumnRenamed("source", "s")
    goals = cut(goals)
    if goals.count() <= BROADCAST_SOURCES:
        goals = F.broadcast(goals)
    all_rows = rows.join(goals, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    within = Window.partitionBy("source").orderBy("k", "key", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    last = all_rows.where("bucket = edge").withColumn("before", F.col("edge_before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    last = last.withColumn("picked", (F.col("before") < F.col("rest")) & (F.col("before") + F.col("size") / 2 <= F.col("rest")))
    others = all_rows.where("edge is null or bucket <> edge").withColumn("picked", F.coalesce(F.col("bucket") < F.col("edge"), F.lit(False)))
    names = [*own, "key", "text_hash", "size", "source", "source_size", "target", "epochs", "picked"]
    out = last.select(*names).unionByName(others.select(*names)).withColumn("picked", F.col("picked") & (F.col("size") > 0))
    return out.withColumn("taken", (F.col("size") * (F.col("epochs") + F.col("picked").cast("int"))).cast("long"))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.0, weights: tuple[float, ...] = WEIGHTS, seed: int = 17, labels: DataFrame | None = None, label_key: str = "doc_id", label: str = "quality") -> DataFrame:
    """The rows of ``docs`` that the mix takes, with size, taken (words, repeats counted) and times (how often).

    Each row is decided by itself, so null and repeated keys are no matter. Columns of these three names are replaced."""
    found = _sampled(docs, key, text, source, share, weights, seed, labels, label_key, label, True).where("taken > 0")
    kept = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c.lower() not in ("size", "taken", "times")]
    return found.select(*kept, "size", "taken", (F.col("taken") / F.col("size")).cast("long").alias("times"))
