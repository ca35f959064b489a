"""Connected components of a link table: alternating large-star and small-star steps in DataFrames, or union-find where the links are few."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drop_stored, spread_join, stored

#: Links up to this many (16 bytes each) are merged in the driver, and the result is broadcast; beyond, the steps go on in DataFrames.
DRIVER_LINKS = 200_000


def _united(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links, sorted, and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(*at.reshape(2, -1).tolist(), strict=True):
        x, y = root(x), root(y)
        parent[max(x, y)] = min(x, y)
    return nodes, nodes[np.array([root(x) for x in range(len(nodes))], dtype=np.int64)]


def _stars(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step over (a, b), a > b; a node with many links is dealt to many tasks."""
    both = links.select(F.col("a").alias("c"), F.col("b").alias("d")).unionByName(links.select(F.col("b").alias("c"), F.col("a").alias("d")))
    least = both.groupBy("c").agg(F.min("d").alias("m"), F.count(F.lit(1)).alias("n"))
    met = spread_join(both.where("d > c"), least.select("c", F.least("c", "m").alias("m")), ["c"], least.select("c", "n"), ["d"])
    large = met.select(F.col("d").alias("a"), F.col("m").alias("b")).distinct()
    down = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.unionByName(down.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b) links -> (node, component): each linked node with the smallest node that it reaches.

    Up to DRIVER_LINKS links are merged in one go.  Of more, every step replaces links by links to smaller nodes and is
    written to the shared folder; it ends when nothing moves, after a number of steps that grows as the square of the
    logarithm of the longest path.  Loops and repeated links are fine; no links give no rows.
    """
    given = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "component-links")
    if given.count() <= DRIVER_LINKS:
        found = given.toArrow()
        drop_stored(given)
        nodes, least = _united(*(found.column(c).to_numpy() for c in ("a", "b")))
        return F.broadcast(links.sparkSession.createDataFrame(pa.table({"node": pa.array(nodes, pa.int64()), "component": pa.array(least, pa.int64())})))
    now = stored(given.distinct(), "component-links")
    drop_stored(given)

    def state(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    before = state(now)
    while True:
        step = stored(_stars(now), "component-links")
        drop_stored(now)
        now, after = step, state(step)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
