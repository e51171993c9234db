"""A driver that keeps what rules derive from a collection up to date."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.collections import Collection
from factloom.operators.shared import cut
from factloom.streaming.rules import Rule, advance


@dataclass
class CollectionDriver:
    """Reads the commits of ``source`` and publishes what the rules add to ``target`` as commits of ``author``.

    ``seen`` is what the last step read: ids of commits. A step does nothing while that hasn't changed; otherwise only what
    follows from the new commits' facts is sought. A step that fails published nothing, and the next one does its work."""

    source: Collection
    target: Collection
    rules: list[Rule]
    author: str = "driver"
    seen: set[str] = field(default_factory=set)

    def dependencies(self) -> set[str]:
        """Ids of the commits that are there: one for each batch that was ever committed."""
        return {r["commit"] for r in self.source.commits().select("commit").distinct().collect()}

    def step(self) -> str | None:
        """Advances once; the id of the commit that it published, None if there was nothing to do."""
        now = self.dependencies()
        new = now - self.seen
        if not new:
            return None
        spark = self.source.spark
        named = spark.createDataFrame([(c,) for c in sorted(now)], "commit string")
        facts = self.source.read(named).facts()
        before = self.target.read().facts() if not self.target.commits().isEmpty() else facts.where("false")
        full = cut(facts.unionByName(before).dropDuplicates(["e", "a", "v"]))
        fresh = self.source.read(spark.createDataFrame([(c,) for c in sorted(new)], "commit string")).facts()
        got = advance(full, self.rules, delta=fresh if self.seen else None)
        added = got.facts.join(full.select("e", "a", "v"), ["e", "a", "v"], "left_anti")
        published = None if added.isEmpty() else self.target.commit(added, self.author)
        self.seen = now
        return published

    def watch(self, seconds: float, steps: int | None = None) -> int:
        """Steps again and again, waiting between; the number of commits published. ``steps`` bounds it."""
        done = published = 0
        while steps is None or done < steps:
            published += self.step() is not None
            done += 1
            if steps is None or done < steps:
                time.sleep(seconds)
        return published


def all_facts(driver: CollectionDriver) -> DataFrame:
    """What the source and the target hold."""
    return driver.source.read().facts().unionByName(driver.target.read().facts()).dropDuplicates(["e", "a", "v"]).select(*[F.col(c) for c in ("e", "a", "v", "int", "num")])
