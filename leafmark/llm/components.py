"""Connected components of a link table, by DataFrame joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.llm.common import release, settle


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (a, b); component is its smallest node.

    Union-find by joins: each round every root is hooked under the smallest root that
    a link shows it (one min per root, combined before the shuffle), then pointers are
    halved until each node points at a root.  Links inside one component are dropped,
    so the work shrinks each round and the number of rounds grows with the logarithm of
    the longest chain.  No links: no rows.
    """
    rest = settle(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    nodes = rest.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    found = held = settle(nodes.select("node", F.col("node").alias("component")))
    while not rest.isEmpty():
        hooks = rest.groupBy(F.col("b").alias("root")).agg(F.min("a").alias("onto"))
        hooked = settle(
            found.join(hooks, found.component == hooks.root, "left").select("node", F.coalesce("onto", "component").alias("component"))
        )
        release(held)
        found = held = hooked
        while True:  # each step halves the way to the root
            up = found.select(F.col("node").alias("component"), F.col("component").alias("above"))
            step = found.join(up, "component").select("node", F.col("component").alias("was"), F.col("above").alias("component"))
            step = settle(step)
            release(held)
            done = step.where("was <> component").isEmpty()
            found, held = step.select("node", "component"), step
            if done:
                break
        a = found.select(F.col("node").alias("a"), F.col("component").alias("ra"))
        b = found.select(F.col("node").alias("b"), F.col("component").alias("rb"))
        before, rest = rest, settle(
            rest.join(a, "a").join(b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        )
        release(before)
    release(rest)
    return found
