"""Preorder numbers and intervals of all nodes of a forest, by an Euler tour and list ranking (H-03, H-05).

A depth-first walk enters and leaves every node once.  What comes before each step is known locally: a node is entered after its
previous sibling was left, or after its parent was entered; it is left after its last child was left, or after it was
entered itself.  So the walk is a linked list, and the sums along it from its head - of nodes entered, and of levels - are
places in preorder and depths.  They are taken by list ranking: a hash picks one step in ``SPACING``, every step finds the
last picked one before it by pointer doubling (the rounds grow with the logarithm of the longest gap, not of the list), and
the picked ones are a shorter list, ranked in the same way, or in one task when it has ``ONE_TASK`` steps at most.

A node and all below it are one interval of places, so a subtree is a range of rows, and ancestors are the nodes whose interval
holds a place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.lineage import cut

SPACING, ONE_TASK = 64, 1_000_000
_SUMS = ("entered", "level")


def previous_siblings(tree: DataFrame) -> DataFrame:
    """tree (parent, ordinal, child) with ``previous``, the child before it under the same parent by (ordinal, child).

    Children are sorted by ranges, so those of one parent may lie in many tasks; the last row of each task's range is all
    that the next one needs of it.
    """
    order = ["parent", "ordinal", "child"]
    rows = cut(tree.select(*order).repartitionByRange(*order).sortWithinPartitions(*order))
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            last = batch.slice(batch.num_rows - 1, 1) if batch.num_rows else last
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), last.column(0), last.column(2)], names=["part", "parent", "child"])

    found = rows.mapInArrow(ends, f"part int, parent {kind['parent']}, child {kind['child']}").collect()  # a row a task
    held = sorted((r["part"], r["parent"], r["child"]) for r in found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        before = max((h for h in held if h[0] < part), default=(None, None, None))[1:]
        for batch in batches:
            if not batch.num_rows:
                continue
            parents, children = batch.column(0), batch.column(2)
            shifted = [pa.concat_arrays([pa.array([x], c.type), c.slice(0, len(c) - 1)]) for x, c in zip(before, (parents, children))]
            same = [a == b for a, b in zip(parents.to_pylist(), shifted[0].to_pylist())]
            previous = pa.array([x if s else None for x, s in zip(shifted[1].to_pylist(), same)], children.type)
            before = (parents[-1].as_py(), children[-1].as_py())
            yield pa.RecordBatch.from_arrays([*batch.columns, previous], names=[*order, "previous"])

    return rows.mapInArrow(run, ", ".join(f"{c} {kind[c]}" for c in order) + f", previous {kind['child']}")


def _steps(edges: DataFrame) -> DataFrame:
    """node, leaving and what comes before: before, before_leaving; and what a step adds to the sums."""
    tree = edges.filter("parent is not null and child is not null").groupBy("child").agg(F.min(F.struct("parent", "ordinal")).alias("up"))
    tree = cut(tree.select("up.parent", "up.ordinal", "child"))
    roots = tree.select(F.col("parent").alias("node")).distinct().join(tree.select(F.col("child").alias("node")), "node", "left_anti")
    none = F.lit(None).cast(tree.schema["parent"].dataType)
    last = tree.groupBy(F.col("parent").alias("node")).agg(F.max(F.struct("ordinal", "child")).alias("at")).select("node", F.col("at.child").alias("last"))
    nodes = previous_siblings(tree).select(F.col("child").alias("node"), "parent", "previous").unionAll(roots.select("node", none.alias("parent"), none.alias("previous")))
    nodes = nodes.join(last, "node", "left")
    enter = F.struct(F.lit(False).alias("leaving"), F.coalesce("previous", "parent").alias("before"), F.col("previous").isNotNull().alias("before_leaving"), F.lit(1).alias("entered"), F.lit(1).alias("level"))
    leave = F.struct(F.lit(True).alias("leaving"), F.coalesce("last", "node").alias("before"), F.col("last").isNotNull().alias("before_leaving"), F.lit(0).alias("entered"), F.lit(-1).alias("level"))
    return nodes.select("node", F.explode(F.array(enter, leave)).alias("step")).select("node", "step.*", F.col("node").alias("head"))


def ranked(steps: DataFrame, spacing: int = SPACING, one_task: int = ONE_TASK) -> DataFrame:
    """(node, leaving, entered, level, head): sums from the head of each step's list, and the head's node; steps behind a cycle are left out."""
    steps = cut(steps.select("node", "leaving", "before", "before_leaving", *(F.col(s).cast("bigint").alias(s) for s in _SUMS), "head"))
    n = steps.count()
    if n <= one_task:
        kind = steps.schema["node"].dataType.simpleString()
        return steps.coalesce(1).mapInArrow(_in_one_task, f"node {kind}, leaving boolean, entered bigint, level bigint, head {kind}")
    picked = lambda node, leaving: F.pmod(F.xxhash64(node, leaving, F.lit(n)), F.lit(spacing)) == 0
    done = lambda: F.col("before").isNull() | picked("before", "before_leaving")
    # A gap of all steps is crossed in so many rounds; what goes on after that is a cycle.
    for _ in range(n.bit_length() + 1):
        going = steps.filter(~done())
        if going.isEmpty():
            break
        back = steps.select(F.col("node").alias("before"), F.col("leaving").alias("before_leaving"), F.col("before").alias("_before"), F.col("before_leaving").alias("_leaving"), *(F.col(s).alias(f"_{s}") for s in _SUMS), F.col("head").alias("_head"))
        moved = going.join(back, ["before", "before_leaving"]).select("node", "leaving", F.col("_before").alias("before"), F.col("_leaving").alias("before_leaving"), *((F.col(s) + F.col(f"_{s}")).alias(s) for s in _SUMS), F.col("_head").alias("head"))
        steps = cut(steps.filter(done()).unionAll(moved))
    steps = steps.filter(done())
    shorter = ranked(steps.filter(picked("node", "leaving")), spacing, one_task)
    total = shorter.select(F.col("node").alias("before"), F.col("leaving").alias("before_leaving"), *(F.col(s).alias(f"_{s}") for s in _SUMS), F.col("head").alias("_head"))
    whole = steps.filter("before is null").select("node", "leaving", *_SUMS, "head")
    rest = steps.join(total, ["before", "before_leaving"]).select("node", "leaving", *((F.col(s) + F.col(f"_{s}")).alias(s) for s in _SUMS), F.col("_head").alias("head"))
    return whole.unionAll(rest)


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same for a list of bounded size, by pointer doubling over its numbers."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    table = pa.Table.from_batches(parts).combine_chunks()
    node, leaving, before, before_leaving, *sums, head = (c.chunk(0) for c in table.columns)
    n = len(node)
    codes = pa.concat_arrays([node, before]).dictionary_encode().indices
    mine = np.asarray(codes.slice(0, n)).astype(np.int64) * 2 + np.asarray(leaving.cast(pa.int8()))
    asked = np.asarray(codes.slice(n).fill_null(-1)).astype(np.int64) * 2 + np.asarray(before_leaving.cast(pa.int8()).fill_null(0))
    at = np.full(int(max(mine.max(), asked.max())) + 1, -1, np.int64)
    at[mine] = np.arange(n)
    start = np.asarray(before.is_null())
    to = np.where(start, n, at[np.maximum(asked, 0)])  # n stands before every head
    bad = to < 0  # a step that is left out, as it is behind a cycle
    to = np.append(np.where(bad, np.arange(n), to), n)
    total = [np.append(np.asarray(s), 0) for s in sums]
    first = np.append(np.arange(n), n)
    for _ in range(n.bit_length() + 1):
        for s in total:
            s += s[to]
        first = np.where(to < n, first[to], first)
        to = to[to]
    ok = np.flatnonzero(to[:n] == n)
    for low in range(0, len(ok), 10_000):
        some = ok[low : low + 10_000]
        pick = pa.array(some)
        yield pa.RecordBatch.from_arrays([node.take(pick), leaving.take(pick), *(pa.array(s[some]) for s in total), head.take(pa.array(first[some]))], names=["node", "leaving", *_SUMS, "head"])


def tour(edges: DataFrame, spacing: int = SPACING, one_task: int = ONE_TASK) -> DataFrame:
    """node, root, depth (root 0), place and last: a node's place in preorder by (ordinal, child) in its tree from 1 on, and that of the last node below it.

    edges: parent, child, ordinal.  Of several parents the smallest counts (with the smallest ordinal); nodes on or under a cycle are left out.
    """
    rows = ranked(_steps(edges), spacing, one_task)
    enter, leave = F.when(~F.col("leaving"), F.struct("head", "level", "entered")), F.when(F.col("leaving"), F.col("entered"))
    whole = rows.groupBy("node").agg(F.max(enter).alias("a"), F.max(leave).alias("last")).filter("a is not null and last is not null")
    return whole.select("node", F.col("a.head").alias("root"), (F.col("a.level") - 1).alias("depth"), F.col("a.entered").alias("place"), "last")


def below(tour_: DataFrame, root: object, max_depth: int) -> DataFrame:
    """H-05: node, depth (root 1) and place of the nodes from ``root`` down to a depth: a range of places."""
    at = tour_.filter(F.col("node") == F.lit(root)).first()
    if at is None or max_depth <= 0:
        return tour_.limit(0).select("node", "depth", "place")
    mine = tour_.filter((F.col("root") == F.lit(at["root"])) & F.col("place").between(at["place"], at["last"]) & (F.col("depth") < at["depth"] + max_depth))
    return mine.select("node", (F.col("depth") - at["depth"] + 1).alias("depth"), (F.col("place") - at["place"] + 1).alias("place"))
