"""Best-fit packing by linear grouping: as few windows of a fixed number of tokens as can be.

Only documents longer than a window are cut, into full windows and what is left.  How many pieces there are of each
length is all that a packing depends on, and that histogram has no more entries than a window has tokens, whatever the
corpus' size; so the packing is planned on the driver and carried out by tasks.

The plan: large lengths, sorted, are parted into groups of equal cardinality and rounded up to the largest of their
group.  The few sizes that remain make configurations (which sizes share a window); how often each is used is a
linear programme, solved by column generation with a knapsack over the capacity, and rounded down.  Actual lengths,
longest first, then take the places of the rounded ones, which leaves rooms that differ.  What rounding down has left
over and the small lengths go best fit, longest first, into the tightest window that holds them.  Windows with equal
contents so far are one *run*, so a step costs the same for ten windows as for ten billion.  A plan is made for a
few numbers of groups and bounds of "large", and the one with the fewest windows is taken.

Carrying out: every piece gets its rank among the pieces of its length - tasks number their own and prefix sums over
the tasks' counts are added - and a table of the plan's steps gives ranks their windows and offsets.

Defined results: a null text is an empty one and holds the end id alone; null and repeated ids are kept as rows of their own; an
empty table gives no rows; a very long text is encoded by stretches and held as ids, four bytes each; other columns
are left out.  Pieces of one length are interchangeable; which of them comes where follows the order in which they were read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.packing import OpenWindows, cut, spread
from tessera.llm.store import materialise
from tessera.llm.textblocks import blocks
from tessera.llm.tokens import encoder

#: (groups, a length is large beyond capacity / this): plans are made for each; the first of the best is taken.
VARIANTS = ((24, 6), (48, 6), (24, 3), (96, 4), (16, 2))
#: Columns that a linear programme may take on; its solution is feasible after each.
COLUMNS = 500
#: Rows of counts (a task and length each, 24 bytes) up to which they are broadcast.
SMALL_ROWS = 200_000
SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids binary, part int, number bigint"


def groups_of(lengths: list[int], counts: list[int], groups: int) -> list[list[list[int]]]:
    """Descending (length, count) in groups of equal cardinality; groups that round to one size are one."""
    quota, out, room = -(-sum(counts) // groups), [], 0
    for length, count in zip(lengths, counts):
        while count:
            if not room:
                room = quota
                if not out or out[-1][0][0] != length:
                    out.append([])
            some = min(count, room)
            out[-1].append([length, some])
            count, room = count - some, room - some
    return out


def dearest(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each size a window takes so that their worth is largest."""
    most = capacity // int(sizes.min())
    value, chosen = np.zeros(capacity + 1), []
    left = np.arange(capacity + 1)[None, :] - sizes[:, None]
    for _ in range(most):  # one more item at a time
        offers = np.where(left >= 0, value[np.maximum(left, 0)] + worth[:, None], -1.0)
        best = offers.argmax(0)
        gain = offers[best, np.arange(capacity + 1)]
        chosen.append(np.where(gain > value + 1e-12, best, -1))
        value = np.maximum(gain, value)
    out, room = np.zeros(len(sizes)), capacity
    for best in reversed(chosen):
        if best[room] >= 0:
            out[best[room]] += 1
            room -= int(sizes[best[room]])
    return out


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[int, list[int]]]:
    """(windows, items of each size in one) whose sum leaves a few items a size over, by column generation."""
    size, need = np.array(sizes), np.array(demand, float)
    basis = np.diag((capacity // size).astype(float))
    for _ in range(COLUMNS):
        worth = np.linalg.solve(basis.T, np.ones(len(size)))
        column = dearest(size, worth, capacity)
        if column @ worth <= 1 + 1e-9:
            break
        direction, x = np.linalg.solve(basis, column), np.linalg.solve(basis, need)
        steps = np.where(direction > 1e-9, np.maximum(x, 0) / np.where(direction > 1e-9, direction, 1), np.inf)
        basis[:, int(steps.argmin())] = column
    used, left, out = np.floor(np.linalg.solve(basis, need) + 1e-6), [int(d) for d in demand], []
    for j in range(len(sizes)):
        config = [int(c) for c in np.rint(basis[:, j])]
        times = min([int(max(used[j], 0)), *(left[i] // c for i, c in enumerate(config) if c)])
        if times:
            left = [n - times * c for n, c in zip(left, config)]
            out.append((times, config))
    return out


class Plan:
    """Steps: ``count`` pieces of a length from a rank on go to windows ``first`` ..., ``each`` to one, from ``offset`` on."""

    def __init__(self, histogram: dict[int, int], capacity: int, groups: int, large: int):
        self.capacity, self.windows = capacity, 0
        self.left = dict(histogram)
        self.rank = dict.fromkeys(histogram, 0)
        self.steps: list[tuple[int, int, int, int, int]] = []
        self.runs: list[tuple[int, int]] = []  # (first window, how many)
        self.open = OpenWindows(capacity)
        if full := self.left.get(capacity, 0):
            self._step(capacity, full, self._new(full), 1, 0)
        lengths = sorted((n for n in histogram if capacity // large < n < capacity), reverse=True)
        if lengths:
            self._configure(groups_of(lengths, [histogram[n] for n in lengths], groups))
        for length in sorted((n for n, count in self.left.items() if count), reverse=True):
            self._best_fit(length)

    def _new(self, count: int) -> int:
        self.windows += count
        return self.windows - count

    def _step(self, length: int, count: int, first: int, each: int, offset: int) -> None:
        self.steps.append((length, self.rank[length], first, each, offset))
        self.rank[length] += count
        self.left[length] -= count

    def _put(self, first: int, count: int, room: int) -> None:
        if room and count:
            self.open.put(room, len(self.runs))
            self.runs.append((first, count))

    def _configure(self, grouped: list[list[list[int]]]) -> None:
        queues = [[list(x) for x in reversed(group)] for group in grouped]
        for times, config in configurations([g[0][0] for g in grouped], [sum(n for _, n in g) for g in grouped], self.capacity):
            runs = [(self._new(times), times, 0)]
            for queue, items in zip(queues, config):
                for _ in range(items):
                    filled = []
                    for first, count, offset in runs:
                        while count:
                            length, some = queue[-1][0], min(count, queue[-1][1])
                            self._step(length, some, first, 1, offset)
                            filled.append((first, some, offset + length))
                            first, count = first + some, count - some
                            queue[-1][1] -= some
                            if not queue[-1][1]:
                                queue.pop()
                    runs = filled
            for first, count, offset in runs:
                self._put(first, count, self.capacity - offset)

    def _best_fit(self, length: int) -> None:
        while n := self.left[length]:
            found = self.open.take(length)
            if not found:
                count = -(-n // (self.capacity // length))
                found = self.capacity, len(self.runs)
                self.runs.append((self._new(count), count))
            room, (first, count) = found[0], self.runs[found[1]]
            each, offset = room // length, self.capacity - room
            whole = min(n // each, count)
            if whole:
                self._step(length, whole * each, first, each, offset)
                self._put(first, whole, room - each * length)
            rest = min(n - whole * each, each) if whole < count else 0
            if rest:
                self._step(length, rest, first + whole, rest, offset)
                self._put(first + whole, 1, room - rest * length)
            self._put(first + whole + (rest > 0), count - whole - (rest > 0), room)


def planned(histogram: dict[int, int], capacity: int) -> Plan:
    """The plan with the fewest windows of those that VARIANTS give."""
    return min((Plan(histogram, capacity, groups, large) for groups, large in VARIANTS), key=lambda p: p.windows)


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """The documents' pieces with their ids, the task that read them and their numbers among its pieces of their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for low, high, data, offsets in blocks(batch.column(1)):
                ids, at = enc.encode(data, offsets)
                n = high - low
                full = np.full(len(ids) + n, end_id, np.uint32)
                full[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(at))] = ids
                doc, start, length = cut(np.diff(at) + 1, capacity)
                begin = (at[:-1] + np.arange(n))[doc] + start
                order = np.argsort(length, kind="stable")
                size, first, count = np.unique(length[order], return_index=True, return_counts=True)
                number = np.zeros(len(doc), np.int64)
                number[order] = np.arange(len(doc)) - np.repeat(first, count) + np.repeat(seen[size], count)
                seen[size] += count
                key = batch.column(0).slice(low, n)
                for a in range(0, len(doc), 1024):
                    s = slice(a, a + 1024)
                    bounds = np.concatenate([[0], np.cumsum(length[s] * 4)]).astype(np.int32)
                    raw = pa.py_buffer(full[spread(begin[s], length[s])].tobytes())
                    yield pa.RecordBatch.from_arrays(
                        [
                            key.take(pa.array(doc[s])),
                            pa.array((start[s] // capacity).astype(np.int32)),
                            pa.array(start[s]),
                            pa.array(length[s]),
                            pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.tobytes()), raw]),
                            pa.array(np.full(len(bounds) - 1, part, np.int32)),
                            pa.array(number[s]),
                        ],
                        names=["doc_id", "piece", "start", "length", "ids", "part", "number"],
                    )

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit), sequence_id and offset of every piece."""
    cut_up = materialise(pieces(docs, tokenizer, end_id, capacity))
    counts = materialise(cut_up.groupBy("part", "length").agg(F.count("*").alias("n")), compact=True)
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    steps = sorted(planned(histogram, capacity).steps)
    length, rank, first, each, offset = np.array(steps, np.int64).reshape(-1, 5).T
    key = length << 48 | rank

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(size: pd.Series, at: pd.Series) -> pd.DataFrame:
        size, at = size.to_numpy(np.int64), at.to_numpy(np.int64)
        step = np.searchsorted(key, size << 48 | at, "right") - 1
        past = at - rank[step]
        return pd.DataFrame({"sequence_id": first[step] + past // each[step], "offset": offset[step] + past % each[step] * size})

    order = Window.partitionBy("length").orderBy("part")  # a row a task, whatever the number of pieces
    before = counts.select("part", "length", (F.sum("n").over(order) - F.col("n")).alias("before"))
    if counts.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        before = F.broadcast(before)
    ranked = cut_up.join(before, ["part", "length"]).withColumn("place", place("length", F.col("before") + F.col("number")))
    return ranked.select("doc_id", "piece", "start", "length", "ids", "place.sequence_id", "place.offset")
