"""Collections: grow-only sets of commits, which of them are admitted, and data derived from them.

A commit is a batch of facts under a content id, by an author. Signatures are left to the storage that commits come
from; admission here decides by author.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.shared import cut
from factloom.sources.facts import COLUMNS, FactSource

COMMIT = "commit string, author string"


def batch_id(facts: DataFrame, author: str) -> str:
    """Id of a batch of distinct facts: SHA-256 over the sorted digests of its parts, and the author. A part is the facts
    whose hashes begin alike, and its digest that of their sorted hashes; parts are split further where they are large."""
    h = F.sha2(F.concat_ws("\x1f", "e", "a", "v"), 256)
    digits = 2
    rows = facts.select(h.alias("h"))
    count = rows.count()
    while count > 16 ** digits * 1000:
        digits += 1
    parts = rows.groupBy(F.substring("h", 1, digits).alias("p")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("d"))
    while digits > 2:  # a tree: no more than 256 digests meet in one value
        digits = max(2, digits - 2)
        parts = parts.groupBy(F.substring("p", 1, digits).alias("p")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("d")), ""), 256).alias("d"))
    whole = F.sha2(F.concat(F.lit(f"{len(author)}:{author}{count}:"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "d"))), lambda x: x["d"]), "")), 256)
    return parts.agg(F.substring(whole, 1, 32)).first()[0]


@dataclass
class Collection:
    """A folder of commits: facts as Parquet, partitioned by commit, and a record of each."""

    spark: SparkSession
    path: str

    def commit(self, facts: DataFrame, author: str) -> str:
        """Appends a batch and gives its id, which follows from author and facts: equal batches are one commit."""
        rows = facts.select(*COLUMNS).dropDuplicates(["e", "a", "v"])
        name = batch_id(rows, author)
        rows.repartitionByRange("a", "v").sortWithinPartitions("a", "v", "e").write.mode("overwrite").parquet(f"{self.path}/facts/commit={name}")
        self.spark.range(1).select(F.lit(name).alias("commit"), F.lit(author).alias("author")).write.mode("overwrite").parquet(f"{self.path}/records/{name}")
        return name

    def commits(self) -> DataFrame:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/records")
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], COMMIT)
        return self.spark.read.schema(COMMIT).option("recursiveFileLookup", "true").parquet(f"{self.path}/records")

    def read(self, admitted: DataFrame | None = None) -> FactSource:
        """The union of all commits, or of those admitted (a column ``commit``); facts in several count once."""
        facts = self.spark.read.schema("e string, a string, v string, int bigint, num double, commit string").parquet(f"{self.path}/facts")
        facts = facts.join(self.commits().select("commit"), "commit", "left_semi")  # a batch without its record isn't committed
        if admitted is not None:
            facts = facts.join(admitted.select("commit"), "commit", "left_semi")
        return FactSource(facts.select(*COLUMNS), distinct=False)


def delegated(grants: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, subject): whom each root supports, by chains of grants (issuer, subject) from the root down; a root
    supports itself."""
    seen = new = cut(roots.select(F.col("root"), F.col("root").alias("subject")).distinct())
    while not new.isEmpty():
        step = new.join(grants.select(F.col("issuer").alias("subject"), F.col("subject").alias("next")), "subject").select("root", F.col("next").alias("subject")).distinct()
        new = cut(step.join(seen, ["root", "subject"], "left_anti"))
        seen = cut(seen.unionByName(new))
    return seen


GRANTS = "issuer string, subject string, right string"
RIGHTS = ("read", "write")


def grant(spark: SparkSession, path: str, issuer: str, subject: str, right: str) -> None:
    """Appends a grant to the table at ``path``; a grant given twice is one."""
    if right not in RIGHTS:
        raise ValueError(f"a right is one of {RIGHTS}")
    spark.createDataFrame([(issuer, subject, right)], GRANTS).write.mode("append").parquet(path)


def grants_at(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GRANTS).parquet(path).distinct()


@dataclass(frozen=True)
class Policy:
    """Open (no roots), or a quorum: an author needs the support of ``threshold`` distinct roots."""

    roots: tuple[str, ...] = ()
    threshold: int = 1

    def __post_init__(self) -> None:
        if self.roots and not 1 <= self.threshold <= len(set(self.roots)):
            raise ValueError("the threshold must be from 1 to the number of roots")

    def admitted(self, commits: DataFrame, grants: DataFrame | None = None, right: str | None = None) -> DataFrame:
        """The commits (commit, author) whose author may write. With ``right``, only grants of it count (a column ``right``)."""
        if not self.roots:
            return commits
        if right is not None and grants is not None:
            grants = grants.where(F.col("right") == right).select("issuer", "subject")
        spark = commits.sparkSession
        roots = spark.createDataFrame([(r,) for r in set(self.roots)], "root string")
        none = spark.createDataFrame([], "issuer string, subject string")
        support = delegated(none if grants is None else grants, roots).groupBy("subject").agg(F.count("*").alias("n")).where(F.col("n") >= self.threshold)
        return commits.join(support.select(F.col("subject").alias("author")), "author", "left_semi").select(*commits.columns)


@dataclass
class Derivations:
    """Registered derived data: name -> (source names, function of their DataFrames). ``refresh`` computes them in the
    order of their sources and writes each under its name."""

    entries: dict[str, tuple[tuple[str, ...], Callable[..., DataFrame]]] = field(default_factory=dict)

    def derive(self, name: str, sources: tuple[str, ...], function: Callable[..., DataFrame]) -> None:
        if name in self.entries:
            raise ValueError(f"{name} is registered")
        self.entries[name] = (sources, function)

    def order(self, changed: set[str] | None = None) -> list[str]:
        """The derived names in an order in which sources come first; only those downstream of ``changed`` if given."""
        out: list[str] = []
        path: set[str] = set()

        def visit(n: str) -> None:
            if n in out or n not in self.entries:
                return
            if n in path:
                raise ValueError(f"{n} is derived from itself")
            path.add(n)
            for s in self.entries[n][0]:
                visit(s)
            path.discard(n)
            out.append(n)

        for n in self.entries:
            visit(n)
        if changed is not None:
            dirty = set(changed)
            for n in out:
                if dirty & set(self.entries[n][0]):
                    dirty.add(n)
            out = [n for n in out if n in dirty]
        return out

    def maintain(self, sources: dict[str, DataFrame], path: str, state: dict[str, tuple]) -> tuple[dict[str, DataFrame], list[str]]:
        """Refreshes what follows from the sources that changed since ``state`` (name -> fingerprint, brought up to date
        here), and says which were."""
        now = {n: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64(*df.columns)), F.sum(F.pmod(F.xxhash64(*df.columns), F.lit(1 << 40)))).first()) for n, df in sources.items()}
        changed = {n for n, x in now.items() if state.get(n) != x}
        todo = self.order(changed)
        out = self.refresh(sources, path, changed)
        state.update(now)
        return out, todo

    def watch(self, read: Callable[[], dict[str, DataFrame]], path: str, seconds: float, steps: int | None = None) -> list[list[str]]:
        """Maintains again and again, reading the sources anew; the names refreshed in each step."""
        state: dict[str, tuple] = {}
        out: list[list[str]] = []
        while steps is None or len(out) < steps:
            out.append(self.maintain(read(), path, state)[1])
            if steps is None or len(out) < steps:
                time.sleep(seconds)
        return out

    def rederive(self, sources: dict[str, DataFrame], path: str, name: str) -> dict[str, DataFrame]:
        """Computes one derived table again, and all that follow from it."""
        if name not in self.entries:
            raise ValueError(f"{name} isn't derived")
        return self._write(sources, path, [name, *self.order({name})])

    def refresh(self, sources: dict[str, DataFrame], path: str, changed: set[str] | None = None) -> dict[str, DataFrame]:
        return self._write(sources, path, self.order(changed))

    def _write(self, sources: dict[str, DataFrame], path: str, names: list[str]) -> dict[str, DataFrame]:
        tables = dict(sources)
        spark = next(iter(sources.values())).sparkSession
        for n in self.entries:
            if n not in names and n not in tables:
                tables[n] = spark.read.parquet(f"{path}/{n}")
        for n in names:
            needs, function = self.entries[n]
            function(*[tables[s] for s in needs]).write.mode("overwrite").parquet(f"{path}/{n}")
            tables[n] = spark.read.parquet(f"{path}/{n}")
        return tables
