"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import discard, materialise


def _star(edges: DataFrame) -> DataFrame:
    """edges (u, v) in both directions -> (u, v, m) with m the least of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


#: So many links (16 MB) are united by one task; more by distributed steps.
ONE_TASK = 1_000_000


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every link's greater root takes the lesser one's place, and roots are followed to their ends, until no link has two."""
    parts = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches]
    if not sum(len(u) for u, _ in parts):
        return
    nodes, at = np.unique(np.concatenate([u for u, _ in parts] + [v for _, v in parts]), return_inverse=True)
    u, v = at[: len(at) // 2], at[len(at) // 2 :]
    root = np.arange(len(nodes))
    while len(u):
        low, high = np.minimum(root[u], root[v]), np.maximum(root[u], root[v])
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
        apart = root[u] != root[v]
        u, v = u[apart], v[apart]
    for a in range(0, len(nodes), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[a : a + 100_000]), pa.array(nodes[root[a : a + 100_000]])], names=["node", "component"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of links (u bigint, v bigint): the component's smallest node."""
    if links.count() <= ONE_TASK:
        return links.select("u", "v").coalesce(1).mapInArrow(_united, "node bigint, component bigint")
    return star_components(links)


def star_components(links: DataFrame) -> DataFrame:
    """The same for any number of links.

    Every step writes the links that are left to the shared folder; nothing but their number and a checksum
    comes to the driver.  The number of steps grows with the logarithm of the longest chain.
    """
    now = materialise(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), compact=True)
    mark = None
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        after = materialise(small.filter("u <> v").distinct(), compact=True)
        discard(now)
        now, got = after, after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if got == mark or not got[0]:
            break
        mark = got
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
