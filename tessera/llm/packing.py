"""Packing: best-fit decreasing into windows of a fixed number of tokens.

Documents longer than a window are first cut into full windows.  What is left of them, and the shorter ones, is packed
where it is read, in groups of bounded size, so that hardly anything is shuffled and a lost task packs the same group
again: longest first, and a segment tree over the remaining capacities finds the tightest open window that
holds a piece.  Windows that a group leaves unfilled are opened again, emptiest first: their pieces go on to the task's next group, and those of
its last group to a second pass, in which the pieces of all tasks meet.  So the padding doesn't grow with the number of partitions.

Defined results: a null text is an empty one and holds the end id alone; null and repeated ids are kept as
rows of their own; an empty table gives no rows; a very long text is encoded by stretches and held as ids, four bytes
each; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import materialise
from tessera.llm.textblocks import blocks
from tessera.llm.tokens import encoder

#: A group is packed when it holds so many tokens or documents (64 MB of ids).
GROUP_TOKENS, GROUP_DOCUMENTS = 16 << 20, 1 << 17
#: A window emptier than this is unfilled; so many tokens of unfilled windows are opened again by a group.
FILLED, REOPENED = 0.99, 1 << 18
#: Tokens of a group of the second pass (2 MB of ids).
SECOND_TOKENS = 1 << 19
SCHEMA = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


class OpenWindows:
    """Open windows by remaining capacity; a segment tree tells which capacities have any."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, window: int) -> None:
        self.at[room].append(window)
        i = room + self.size
        while i and not self.any[i]:
            self.any[i] = 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, window) of a window with the least remaining capacity that is ``need`` or more."""
        i = need + self.size
        while not self.any[i]:
            while i & 1:
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.size:
            i = 2 * i if self.any[2 * i] else 2 * i + 1
        room = i - self.size
        window = self.at[room].pop()
        if not self.at[room]:
            self.any[i] = 0
            i >>= 1
            while i and not (self.any[2 * i] or self.any[2 * i + 1]):
                self.any[i] = 0
                i >>= 1
        return room, window


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(window, offset) of each piece of 1 to ``capacity`` tokens, and the number of windows."""
    window, offset, opened, windows = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0, OpenWindows(capacity)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        if need < capacity and (found := windows.take(need)):
            room, window[i] = found
        else:
            room, window[i], opened = capacity, opened, opened + 1
        offset[i] = capacity - room
        if room > need:
            windows.put(room - need, int(window[i]))
    return window, offset, opened


def cut(tokens: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of the pieces: full windows, then what is left."""
    pieces = (tokens + capacity - 1) // capacity
    doc = np.repeat(np.arange(len(tokens)), pieces)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
    return doc, start, np.minimum(tokens[doc] - start, capacity)


class Pieces:
    """Pieces held for packing: their documents' ids and sizes, where they start, and their token ids end to end."""

    def __init__(self, capacity: int, sequence: int):
        self.capacity, self.sequence = capacity, sequence
        self.clear()

    def clear(self) -> None:
        self.parts: list[tuple] = []
        self.tokens = self.count = 0

    def add(self, key: pa.Array, start: np.ndarray, length: np.ndarray, tokens: np.ndarray, ids: np.ndarray) -> None:
        if len(start):
            self.parts.append((key, start, length, tokens, ids))
            self.tokens, self.count = self.tokens + len(ids), self.count + len(start)

    def packed(self, again: bool) -> Iterator[pa.RecordBatch]:
        """The group's windows; with ``again`` the pieces of unfilled ones stay held instead."""
        if not self.parts:
            return
        keys, *rest = zip(*self.parts)
        key, (start, length, tokens, ids) = pa.concat_arrays(keys), (np.concatenate(x) for x in rest)
        at = np.cumsum(length) - length
        self.clear()
        window, offset, opened = best_fit_decreasing(length, self.capacity)
        fill = np.bincount(window, length, opened).astype(np.int64)
        emptiest = np.argsort(fill, kind="stable")
        loose = np.zeros(opened, bool)
        loose[emptiest[(fill[emptiest] < FILLED * self.capacity) & (np.cumsum(fill[emptiest]) <= REOPENED)]] = True
        back = loose[window]
        yield from self._rows(key, start, length, tokens, ids, at, np.flatnonzero(~back if again else np.ones(len(start), bool)), self.sequence + window, offset, back & (not again))
        self.sequence += opened
        if again:
            some = np.flatnonzero(back)
            self.add(key.take(pa.array(some)), start[some], length[some], tokens[some], ids[spread(at[some], length[some])])

    def whole(self, key: pa.Array, start: np.ndarray, length: np.ndarray, tokens: np.ndarray, ids: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Pieces that fill a window each."""
        n = len(start)
        yield from self._rows(key, start, length, tokens, ids, at, np.arange(n), self.sequence + np.arange(n), np.zeros(n, np.int64), np.zeros(n, bool))
        self.sequence += n

    @staticmethod
    def _rows(key, start, length, tokens, ids, at, some, sequence, offset, loose) -> Iterator[pa.RecordBatch]:
        for low in range(0, len(some), 1024):
            s = some[low : low + 1024]
            bounds = np.concatenate([[0], np.cumsum(length[s] * 4)])
            raw = pa.py_buffer(ids[spread(at[s], length[s])].tobytes())
            binary = pa.Array.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), raw])
            yield pa.RecordBatch.from_arrays(
                [key.take(pa.array(s)), pa.array(start[s]), pa.array(length[s]), binary, pa.array(tokens[s]), pa.array(sequence[s]), pa.array(offset[s]), pa.array(loose[s])],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "loose"],
            )


def spread(at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers at[i] ... at[i] + length[i] - 1, i after i."""
    return np.repeat(at - (np.cumsum(length) - length), length) + np.arange(length.sum())


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096) -> DataFrame:
    """One row a piece of a document: its ids (little-endian unsigned 32-bit) and its place in a sequence."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, held = encoder(tokenizer), Pieces(capacity, TaskContext.get().partitionId() << 33)
        for batch in batches:
            for low, high, data, offsets in blocks(batch.column(1)):
                ids, at = enc.encode(data, offsets)
                n = high - low
                full = np.full(len(ids) + n, end_id, np.uint32)
                full[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(at))] = ids
                tokens, key = np.diff(at) + 1, batch.column(0).slice(low, n)
                doc, start, length = cut(tokens, capacity)
                begin, filled = (at[:-1] + np.arange(n))[doc] + start, length == capacity
                one = np.flatnonzero(filled)
                yield from held.whole(key.take(pa.array(doc[one])), start[one], length[one], tokens[doc[one]], full, begin[one])
                one = np.flatnonzero(~filled)
                held.add(key.take(pa.array(doc[one])), start[one], length[one], tokens[doc[one]], full[spread(begin[one], length[one])])
                if held.tokens >= GROUP_TOKENS or held.count >= GROUP_DOCUMENTS:
                    yield from held.packed(again=True)
        yield from held.packed(again=False)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Pieces(capacity, (1 << 62) + (TaskContext.get().partitionId() << 33))
        for batch in batches:
            length = np.asarray(batch.column(2))
            ids = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint32)
            held.add(batch.column(0), np.asarray(batch.column(1)), length, np.asarray(batch.column(4)), ids)
            if held.tokens >= GROUP_TOKENS:
                yield from held.packed(again=True)
        yield from held.packed(again=False)

    placed = materialise(docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text").mapInArrow(first, SCHEMA + ", loose boolean"))
    loose = placed.filter("loose").drop("loose")
    tokens = loose.agg(F.sum("length")).first()[0] or 0
    again = loose.repartition(-(-tokens // SECOND_TOKENS) or 1).mapInArrow(second, SCHEMA + ", loose boolean")
    return placed.filter("not loose").unionAll(again).drop("loose")
