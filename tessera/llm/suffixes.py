"""Suffix-array dedup: bytes of a text that a string of SPAN bytes covers which also starts earlier.

Every window of SPAN bytes is owned by its *anchor*, the GRAM bytes in it whose hash is least (the leftmost of
equals); equal windows have equal anchors at equal offsets, wherever they stand.  So only the suffixes at
anchors are sorted, about one in forty bytes:

1. Each task finds its texts' anchors, with a hash of the *context*, the bytes of all windows an anchor owns.
   Of equal contexts in a task only the earliest goes on; every other's bytes are compared with those of the one before there and then.
   Anchors are dealt out by hash into buckets.  Where a context was seen earlier, all its windows are repeats, once their bytes
   have been compared with the earlier ones' (the earlier text sends them).  Where an
   anchor has several contexts, the first text of each sends the context's bytes.
2. The suffixes that start at such anchors are sorted by mergesort, an anchor at a time.  Two suffixes are
   compared by their longest common extension, which binary search finds on prefix polynomial hashes; sorted
   neighbours are verified against their bytes.  For every offset, runs of suffixes that agree far enough, and
   whose bytes before the anchor agree as well, are equal windows; all but the earliest are repeats.
3. A bucket beyond ``MOST`` anchors, as a gram makes that stands in very many different contexts, is not held by one task: its
   windows are hashed one by one, the earliest window of each hash is found by a combined minimum, and all others are repeats of it, once
   their bytes have been compared.
4. Repeats' spans meet the texts, which lose the covered bytes.

No byte is removed on the equality of hashes alone; two different strings with one hash raise ``ArithmeticError``.

Earlier means a smaller doc_id, or an earlier start in the same document.  Defined results: a null text is an
empty one; rows of a null id come last, in an order by text; rows equal in id and text are one document and
get one result each; an empty table gives no rows; a very long text is worked on in overlapping stretches of
``STRETCH`` bytes, with the same result; other columns, whatever their names, are kept by ``remove_repeats``, left out by
``repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bitmap import bitmap, holds
from tessera.llm.store import column, discard, materialise
from tessera.llm.textblocks import BLOCK_BYTES, apart_hashes, blocks, powers, prefix_hashes, release, span_hashes

SPAN, GRAM = 100, 24
REACH = SPAN - GRAM + 1  # anchors' places in a window
BUCKET_BYTES, FLUSH, FLUSH_BYTES, STRETCH = 8 << 20, 200_000, 8 << 20, BLOCK_BYTES
#: Anchors that one task judges and sorts: three times what a bucket has on average.
MOST = 600_000
ANCHOR = np.dtype([("a", "<u8"), ("c", "<u8"), ("id", "<i8"), ("h", "<i8"), ("pos", "<i4"), ("low", "u1"), ("high", "u1")])
LAST = np.iinfo(np.int64).max
_PLAIN = np.arange(256, dtype=np.uint8)


def text_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return apart_hashes(data, offsets[:-1], offsets[1:], _PLAIN).view(np.int64)


def stretches(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(start, bytes, offsets) of a block, or of parts of its one long text that overlap by a window less a byte."""
    if len(data) <= STRETCH + SPAN or len(offsets) > 2:
        yield 0, data, offsets
        return
    for a in range(0, len(data) - SPAN + 1, STRETCH):
        part = data[a : a + STRETCH + SPAN - 1]
        yield a, part, np.array([0, len(part)])


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, position in the block, least and greatest offset of its windows, gram hash, context hash) of each anchor."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < SPAN:
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    prefix = prefix_hashes(data)
    at = np.arange(n - GRAM + 1)
    grams = span_hashes(prefix, at, at + GRAM)
    best = (grams >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
    width = 1
    while width < REACH:  # least of the next `width` values, by doubling
        step = min(width, REACH - width)
        best = np.minimum(best[: len(best) - step], best[step:])
        width += step
    owner = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)  # of the window at each start
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    start = np.flatnonzero(text[: len(owner)] == text[SPAN - 1 :][: len(owner)])
    if not len(start):
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    own = owner[start]
    edge = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (np.diff(start) != 1)]))
    first, last, p = start[edge], start[np.append(edge[1:], len(start)) - 1], own[edge]
    context = span_hashes(prefix, first, last + SPAN)
    return text[p], p, p - last, p - first, grams[p], context


def _once(held: np.ndarray) -> np.ndarray:
    """Whether a row of sorted anchors isn't the row before again: rows equal in id and text are one document."""
    once = np.ones(len(held), bool)
    once[1:] = held[1:] != held[:-1]
    return once


def _runs(held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether a sorted anchor's context is new, the number of the first anchor with its context)."""
    new = np.ones(len(held), bool)
    new[1:] = (held["a"][1:] != held["a"][:-1]) | (held["c"][1:] != held["c"][:-1]) | (held["low"][1:] != held["low"][:-1])
    return new, np.maximum.accumulate(np.where(new, np.arange(len(held)), 0))


def merged_spans(keys: Sequence[np.ndarray], shift: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the first span, start, end) of spans of equal keys and shift that touch, as one."""
    order = np.lexsort((start, shift, *keys))
    if not len(order):
        return order, start, end
    new = np.ones(len(order), bool)
    new[1:] = start[order][1:] > end[order][:-1]
    for k in (shift, *keys):
        new[1:] |= k[order][1:] != k[order][:-1]
    first = np.flatnonzero(new)
    return order[first], start[order][first], np.maximum.reduceat(end[order], first)


def _dealt(held: np.ndarray, where: np.ndarray, text: np.ndarray, data: np.ndarray, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """The anchors by bucket; of equal contexts in this task only the earliest, the others as compared spans (bucket -1).

    ``where``: the anchors' places in ``data``; ``text``: their texts' numbers.
    """
    order = np.lexsort((held["pos"], held["h"], held["id"], held["low"], held["c"], held["a"]))
    order = order[_once(held[order])]
    held, where, text = held[order], where[order], text[order]
    new, _ = _runs(held)
    later = np.flatnonzero(~new)
    high, low = held["high"][later].astype(np.int64), held["low"][later].astype(np.int64)
    shift = where[later] - where[later - 1]  # from the one before, so that a periodic stretch is one span
    one, begin, finish = merged_spans((text[later],), shift, where[later] - high, where[later] - low + SPAN)
    for a, b, d in zip(begin.tolist(), finish.tolist(), shift[one].tolist()):
        if not np.array_equal(data[a:b], data[a - d : b - d]):
            raise ArithmeticError(_COLLISION)
    spans = held[later[one]].copy()
    spans["pos"] = spans["pos"] - (where[later[one]] - begin)
    spans["a"] = spans["pos"] + (finish - begin)
    kept = held[new]
    bucket = ((kept["a"] >> np.uint64(8)) % np.uint64(n_buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    kept, bucket = kept[order], bucket[order]
    cuts = np.searchsorted(bucket, np.arange(n_buckets + 1))
    rows = [(-1, spans)] * bool(len(spans)) + [(b, kept[cuts[b] : cuts[b + 1]]) for b in range(n_buckets) if cuts[b] < cuts[b + 1]]
    for b, part in rows:
        for low in range(0, len(part), 16_384):
            piece = part[low : low + 16_384]
            # field after field, so that the shuffle's compression finds runs
            columns = [pa.array([piece[name].tobytes()], pa.binary()) for name in ANCHOR.names]
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([len(piece)], pa.int64()), *columns], names=["bucket", "n", *ANCHOR.names])


_COLLISION = "two different strings have one hash; use another multiplier"
_DEALT = "bucket int, n bigint, a binary, c binary, id binary, h binary, pos binary, low binary, high binary"


def _unpacked(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    size = sum(len(x) for x in table.column("low").to_pylist())
    out = np.zeros(size, ANCHOR)
    for name in ANCHOR.names:
        out[name] = np.frombuffer(b"".join(table.column(name).to_pylist()), ANCHOR[name])
    return out


#: What an anchor comes to: its context's bytes are wanted; a repeat of the source's, to be compared; a span (pos to a) that was.
_WANTED, _REPEAT, _COMPARED = 0, 1, 2
_FOUND = "kind int, id bigint, h bigint, pos int, low int, high int, a bigint, sid bigint, sh bigint, spos int"


def _found(kind: np.ndarray, rows: np.ndarray, source: np.ndarray) -> pa.RecordBatch:
    columns = [kind.astype(np.int32), rows["id"], rows["h"], rows["pos"], rows["low"].astype(np.int32), rows["high"].astype(np.int32), rows["a"].view(np.int64), source["id"], source["h"], source["pos"]]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=[f.split()[0] for f in _FOUND.split(", ")])


def judged(held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(what they come to, anchors of interest, the earliest anchor with the same context)."""
    held = held[np.lexsort((held["pos"], held["h"], held["id"], held["low"], held["c"], held["a"]))]
    held = held[_once(held)]
    new, first = _runs(held)
    new_a = np.ones(len(held), bool)
    new_a[1:] = held["a"][1:] != held["a"][:-1]
    group = np.cumsum(new_a) - 1
    several = np.bincount(group[new], minlength=group[-1] + 1 if len(group) else 0) > 1
    wanted = new & several[group] if len(group) else new
    use = wanted | ~new
    return np.where(wanted, _WANTED, _REPEAT)[use], held[use], held[first[use]]


def common_extension(prefix: np.ndarray, u: np.ndarray, v: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of the suffixes at u and v, ``limit`` at most: binary search on prefix hashes."""
    inverse = powers(pow(0x9E3779B97F4A7C15, -1, 1 << 64), len(prefix))
    low, high = np.zeros(len(u), np.int64), limit.astype(np.int64)
    iu, iv, pu, pv = inverse[u], inverse[v], prefix[u], prefix[v]
    while (open_ := low < high).any():
        middle = (low + high + 1) // 2
        same = (prefix[u + middle] - pu) * iu == (prefix[v + middle] - pv) * iv
        low = np.where(open_ & same, middle, low)
        high = np.where(open_ & ~same, middle - 1, high)
    return low


def suffix_order(data: np.ndarray, prefix: np.ndarray, at: np.ndarray, length: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of the suffixes data[at:at+length] within each group (groups stand together), by bottom-up mergesort.

    All pairs of runs of a level are merged at once: an element's place is its place in its own run plus its
    rank in the other, which binary search finds with hash-compared suffix comparisons.
    """
    n = len(at)
    order = np.arange(n)
    begin = np.searchsorted(group, group)  # of the element's group
    finish = np.searchsorted(group, group, "right")
    place = np.arange(n) - begin
    width = 1
    while n and width < (finish - begin).max():
        run = place // width
        other_low = begin + (run ^ 1) * width
        other_high = np.minimum(other_low + width, finish)
        active = np.flatnonzero(other_low < finish)
        low, high = other_low[active].copy(), other_high[active].copy()
        mine = order[active]
        left = (run[active] & 1) == 0  # of equal suffixes those of the left run come first
        while (open_ := low < high).any():
            k = np.flatnonzero(open_)
            middle = (low[k] + high[k]) // 2
            theirs = order[middle]
            u, v = at[mine[k]], at[theirs]
            short = np.minimum(length[mine[k]], length[theirs])
            same = common_extension(prefix, u, v, short)
            ended = same == short
            a = np.where(ended, length[mine[k]], data[np.minimum(u + same, len(data) - 1)].astype(np.int64))
            b = np.where(ended, length[theirs], data[np.minimum(v + same, len(data) - 1)].astype(np.int64))
            after = np.where(left[k], b < a, b <= a)  # whether theirs comes before mine
            low[k] = np.where(after, middle + 1, low[k])
            high[k] = np.where(after, high[k], middle)
        pair = begin[active] + (run[active] // 2) * 2 * width
        target = pair + (active - begin[active] - run[active] * width) + (low - other_low[active])
        merged = order.copy()
        merged[target] = mine
        order = merged
        width *= 2
    return order


def repeated_windows(group: np.ndarray, rank: np.ndarray, low: np.ndarray, high: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """For each context (``high`` bytes, then the anchor) the offsets whose window an earlier context of its group holds.

    group: contexts of one anchor stand together; rank: the order of what is earlier; the result has a row a
    context and a column an offset.
    """
    n = len(texts)
    out = np.zeros((n, REACH), bool)
    size = np.array([len(t) for t in texts], np.int64)
    start = np.cumsum(size) - size
    data = np.frombuffer(b"".join(texts), np.uint8)
    prefix = prefix_hashes(data)
    at, length = start + high, size - high
    order = suffix_order(data, prefix, at, length, group)
    shared = np.zeros(n, np.int64)  # bytes in common with the suffix before
    if n > 1:
        u, v = order[:-1], order[1:]
        shared[1:] = np.where(group[u] == group[v], common_extension(prefix, at[u], at[v], np.minimum(length[u], length[v])), 0)
        cell = np.arange(SPAN)
        for a in range(1, n, 4096):  # collision verification: neighbours' bytes
            rows = np.arange(a, min(n, a + 4096))
            x = data[np.minimum(at[order[rows - 1]][:, None] + cell, len(data) - 1)]
            y = data[np.minimum(at[order[rows]][:, None] + cell, len(data) - 1)]
            if ((x != y) & (cell < shared[rows][:, None])).any():
                raise ArithmeticError(_COLLISION)
    low, high, rank, group, at = low[order], high[order], rank[order], group[order], at[order]
    new = np.ones(n, bool)
    new[1:] = group[1:] != group[:-1]
    for o in range(REACH):
        some = np.flatnonzero((low <= o) & (o <= high))
        if len(some) < 2:
            continue
        run = np.cumsum(new | (shared < SPAN - o))[some]
        before = span_hashes(prefix, at[some] - o, at[some])
        by = np.lexsort((rank[some], before, run))
        first = np.concatenate([[True], (run[by][1:] != run[by][:-1]) | (before[by][1:] != before[by][:-1])])
        again = some[by[~first]]
        head = some[by[np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))]][~first]
        span = np.arange(o)
        if o and len(again) and (data[(at[again] - o)[:, None] + span] != data[(at[head] - o)[:, None] + span]).any():
            raise ArithmeticError(_COLLISION)
        out[order[again], o] = True
    return out


def _spans(docs: DataFrame, n_buckets: int, plain: bool) -> tuple[DataFrame, DataFrame]:
    """Anchors judged, and spans (id, h, start, end) of the wanted ones."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        base = texts = anchors_held = 0
        for batch in batches:
            ids = np.asarray(batch.column(0).fill_null(LAST))
            for low, high, data, offsets in blocks(batch.column(1)):
                own = np.zeros(high - low, np.int64) if plain else text_hashes(data, offsets)
                for a, part, cuts in stretches(data, offsets):
                    text, p, least, most, gram, context = anchors(part, cuts)
                    rows = np.zeros(len(text), ANCHOR)
                    rows["a"], rows["c"], rows["id"], rows["pos"] = gram, context, ids[low:high][text], p + a - offsets[text]
                    rows["low"], rows["high"], rows["h"] = least, most, own[text]
                    held.append((rows, p + a + base, text + texts))
                    anchors_held += len(rows)
                held.append((rows[:0], p[:0], text[:0], data))
                base, texts = base + len(data), texts + high - low
                if anchors_held > FLUSH or base > FLUSH_BYTES:
                    yield from deal(held)
                    held.clear()
                    base = texts = anchors_held = 0
        if held:
            yield from deal(held)

    def deal(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows, where, text = (np.concatenate(x) for x in zip(*(h[:3] for h in held)))
        return _dealt(rows, where, text, np.concatenate([h[3] for h in held if len(h) > 3]), n_buckets)

    def judge(table: pa.Table) -> pa.Table:
        rows = _unpacked(table)
        out = (np.full(len(rows), _COMPARED), rows, rows) if table.column("bucket")[0].as_py() < 0 else judged(rows)
        release()
        return pa.Table.from_batches([_found(*out)])

    # A row holds thousands of anchors: small row groups, as a reader takes up to 4,096 rows of one at once.
    dealt = materialise(docs.mapInArrow(find, _DEALT), **{"parquet.block.size": 8 << 20})
    # Buckets beyond MOST are no more than anchors / MOST.
    large = [r["bucket"] for r in dealt.filter("bucket >= 0").groupBy("bucket").agg(F.sum("n").alias("n")).filter(F.col("n") > MOST).collect()]
    # Spans that were compared in their task need no partner: spread them over many groups.
    spread = F.when(F.col("bucket") < 0, -1 - F.pmod(F.xxhash64("pos", "id"), F.lit(n_buckets))).otherwise(F.col("bucket")).cast("int")
    held = dealt.filter(~F.col("bucket").isin(large)) if large else dealt
    found = held.withColumn("bucket", spread).groupBy("bucket").applyInArrow(judge, _FOUND)
    if large:
        found = found.unionAll(_windows(docs, dealt.filter(F.col("bucket").isin(large)), plain))
    found = materialise(found, compact=True)
    discard(dealt)

    asked = found.filter(F.col("kind") == _WANTED).groupBy("id", "h").agg(F.collect_list(F.struct("pos", "low", "high", "a")).alias("asked"))
    seen = bitmap(found.filter(F.col("kind") == _WANTED), _key())
    texts = _texts(docs, seen, plain)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, h, text, asked_ in zip(*(c.to_pylist() for c in batch.columns)):
                for x in asked_:
                    out.append((x["a"], key, h, x["pos"], x["low"], x["high"], text[x["pos"] - x["high"] : x["pos"] - x["low"] + SPAN]))
                if len(out) > 20_000:
                    yield _context_batch(out)
                    out = []
            if out:
                yield _context_batch(out)

    def sort(table: pa.Table) -> pa.Table:
        a = np.asarray(table.column("a").combine_chunks())
        by = np.lexsort((a,))
        columns = {n: np.asarray(table.column(n).combine_chunks())[by] for n in ("a", "id", "h", "pos", "low", "high")}
        texts_ = table.column("bytes").to_pylist()
        texts_ = [texts_[i] for i in by]
        rank = np.empty(len(a), np.int64)
        rank[np.lexsort((columns["pos"], columns["h"], columns["id"]))] = np.arange(len(a))
        hit = repeated_windows(columns["a"], rank, columns["low"].astype(np.int64), columns["high"].astype(np.int64), texts_)
        padded = np.zeros((len(a), REACH + 2), np.int8)
        padded[:, 1:-1] = hit
        row, begin = np.nonzero(np.diff(padded, axis=1) == 1)
        _, end = np.nonzero(np.diff(padded, axis=1) == -1)
        pos = columns["pos"].astype(np.int64)[row]
        return pa.table({"id": columns["id"][row], "h": columns["h"][row], "start": (pos - end + 1).astype(np.int32), "end": (pos - begin + SPAN).astype(np.int32)})

    sent = texts.join(asked, ["id", "h"]).select("id", "h", "text", "asked").mapInArrow(contexts, "a bigint, id bigint, h bigint, pos int, low int, high int, bytes binary")
    sent = sent.withColumn("bucket", F.pmod(F.shiftright("a", 8), F.lit(n_buckets)))
    partial = materialise(sent.groupBy("bucket").applyInArrow(sort, "id bigint, h bigint, start int, end int"), compact=True)
    return found, partial


def _windows(docs: DataFrame, dealt: DataFrame, plain: bool) -> DataFrame:
    """_FOUND rows of the repeats among the windows of these anchors, one window at a time: no group of anchors is held."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = _unpacked(batch.slice(i, 1))
                columns = [rows["id"], rows["h"], rows["pos"] - rows["high"].astype(np.int32), rows["pos"] - rows["low"].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["id", "h", "first", "last"])

    spans = dealt.mapInArrow(unpack, "id bigint, h bigint, first int, last int")
    # A document's windows are consecutive where its anchors are: its spans come together once, as the text does.
    asked = materialise(spans.groupBy("id", "h").agg(F.collect_list(F.struct("first", "last")).alias("asked")))
    texts = _texts(docs, bitmap(asked, _key()), plain)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for id_, h, text, spans_ in zip(*(c.to_pylist() for c in batch.columns)):
                for x in spans_:
                    data = np.frombuffer(text[x["first"] : x["last"] + SPAN], np.uint8)
                    at = np.arange(x["last"] - x["first"] + 1)
                    window = span_hashes(prefix_hashes(data), at, at + SPAN).view(np.int64)
                    columns = [np.full(len(at), id_), np.full(len(at), h), (at + x["first"]).astype(np.int32), window]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "h", "pos", "window"])

    each = materialise(texts.join(asked, ["id", "h"]).select("id", "h", "text", "asked").mapInArrow(hashed, "id bigint, h bigint, pos int, window bigint"))
    discard(asked)
    place = F.struct("id", "h", "pos")
    first = each.groupBy("window").agg(F.min(place).alias("source"), F.count("*").alias("n")).filter("n > 1").select("window", "source")
    again = each.join(first, "window").filter(place != F.col("source"))
    zero = F.lit(0)
    return again.select(
        F.lit(_REPEAT).alias("kind"), "id", "h", "pos", zero.alias("low"), zero.alias("high"), F.col("window").alias("a"), F.col("source.id").alias("sid"), F.col("source.h").alias("sh"), F.col("source.pos").alias("spos")
    )


def _pieces(docs: DataFrame, found: DataFrame, plain: bool) -> DataFrame:
    """(id, h, start, end, piece): the repeats' spans with the bytes of their sources, to be compared.

    Spans of one source that touch are one, so a copied text is one row, and no byte of a source is sent more
    often than it is repeated.
    """
    start = (F.col("pos") - F.col("high")).alias("start")
    rows = found.filter(F.col("kind") == _REPEAT).select("id", "h", start, (F.col("pos") - F.col("low") + SPAN).alias("end"), "sid", "sh", (F.col("pos") - F.col("spos")).alias("shift"))
    names = ("start", "end", "sid", "sh", "shift")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, n = batch.column(2), batch.num_rows
            owner = np.repeat(np.arange(n), np.asarray(lists.value_lengths()))
            start, end, sid, sh, shift = (np.asarray(c) for c in lists.flatten().flatten())
            one, begin, finish = merged_spans((sh, sid, owner), shift, start, end)
            some = pa.array(owner[one])
            columns = [batch.column(0).take(some), batch.column(1).take(some), *(pa.array(np.ascontiguousarray(c)) for c in (begin, finish, sid[one], sh[one], shift[one]))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "h", *names])

    lists = rows.groupBy("id", "h").agg(F.collect_list(F.struct(*names)).alias("spans"))
    spans = materialise(lists.mapInArrow(merge, "id bigint, h bigint, start int, end int, sid bigint, sh bigint, shift int"), compact=True)
    source = F.xxhash64(F.col("sid"), F.col("sh"))
    texts = _texts(docs, bitmap(spans, source), plain).select(F.col("id").alias("sid"), F.col("h").alias("sh"), "text")
    piece = F.substring("text", F.col("start") - F.col("shift") + 1, F.col("end") - F.col("start"))
    return spans.join(texts, ["sid", "sh"]).select("id", "h", "start", "end", piece.alias("piece"))


def _context_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["a", "id", "h", "pos", "low", "high", "bytes"])


def _key():
    return F.xxhash64("id", "h")


def _texts(docs: DataFrame, seen: bytes, plain: bool) -> DataFrame:
    """(id, h, text binary) of each document that the bitmap may hold, once; equal rows are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.flatnonzero(holds(seen, np.asarray(batch.column(2))))
            for low in range(0, len(keep), 256):
                yield pa.RecordBatch.from_arrays([c.take(pa.array(keep[low : low + 256])) for c in (batch.column(0), batch.column(1), batch.column(3))], names=["id", "h", "text"])

    keyed = _keyed(docs, plain).select("id", "h", _key().alias("key"), F.col("text").cast("binary").alias("text"))
    out = keyed.mapInArrow(run, "id bigint, h bigint, text binary")
    return out if plain else out.groupBy("id", "h").agg(F.first("text").alias("text"))


def _keyed(docs: DataFrame, plain: bool) -> DataFrame:
    """docs (doc_id, text) with the key (id, h): h tells apart texts of one id, where ids repeat or are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([*batch.slice(low, high - low).columns, pa.array(text_hashes(data, offsets))], names=[*batch.schema.names, "h"])

    others = [c for c in docs.columns if c == "others"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema)
    keyed = docs.withColumn("h", F.lit(0).cast("bigint")) if plain else docs.mapInArrow(run, f"{schema}, h bigint")
    return keyed.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("id"), "h", F.coalesce("text", F.lit("")).alias("text"), *others)


def _merged(spans: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def repeats(docs: DataFrame, keep: Sequence[str] = (), whole_characters: bool = False) -> DataFrame:
    """doc_id, kept (binary: the bytes that stay), n_bytes, spans (the maximal removed runs' start and end), others (struct; c0, c1, ... are the columns in ``keep``).

    ``whole_characters`` leaves a removed run's ends where they don't cut a UTF-8 character.
    """
    others = F.struct(F.lit(0).alias("c"), *(column(c).alias(f"c{i}") for i, c in enumerate(keep)))
    full = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", others.alias("others"))
    docs = full.select("doc_id", "text")
    n = docs.agg(F.count("*"), F.count_distinct("doc_id"), F.sum(F.octet_length("text"))).first()
    plain = n[0] == n[1]
    found, partial = _spans(docs, max(8, (n[2] or 0) // BUCKET_BYTES), plain)
    compared = found.filter(F.col("kind") == _COMPARED).select("id", "h", F.col("pos").alias("start"), F.col("a").cast("int").alias("end")).unionAll(partial)
    spans = compared.withColumn("piece", F.lit(None).cast("binary")).unionAll(_pieces(docs, found, plain))
    by_doc = materialise(spans.groupBy("id", "h").agg(F.collect_list(F.struct("start", "end", "piece")).alias("spans")), compact=True)
    discard(found, partial)
    seen = bitmap(by_doc, _key())
    extra = full.schema["others"].dataType.simpleString()
    schema = f"doc_id bigint, kept binary, n_bytes bigint, spans array<struct<start:int,end:int>>, others {extra}"
    names = ["doc_id", "kept", "n_bytes", "spans", "others"]
    pair = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.flatnonzero(~holds(seen, np.asarray(batch.column(1))))
            for low in range(0, len(keep), 256):
                text = batch.column(2).take(pa.array(keep[low : low + 256]))
                empty = pa.array([[]] * len(text), pair)
                some = pa.array(keep[low : low + 256])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(some), text, pa.array([len(t) for t in text.to_pylist()], pa.int64()), empty, batch.column(3).take(some)], names=names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for low in range(0, len(ids), 256):
                kept, size, runs = [], [], []
                for text, spans_ in zip(batch.column(1).slice(low, 256).to_pylist(), batch.column(2).slice(low, 256).to_pylist()):
                    merged = _merged([(x["start"], x["end"]) for x in spans_ or []])
                    if any(x["piece"] is not None and text[x["start"] : x["end"]] != x["piece"] for x in spans_ or []):
                        raise ArithmeticError(_COLLISION)
                    if whole_characters:
                        merged = [m for m in (_inward(text, *m) for m in merged) if m[0] < m[1]]
                    edges = [0, *(e for m in merged for e in m), len(text)]
                    kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                    size.append(len(text))
                    runs.append([{"start": a, "end": b} for a, b in merged])
                yield pa.RecordBatch.from_arrays([pa.array(ids[low : low + 256], pa.int64()), pa.array(kept, pa.binary()), pa.array(size, pa.int64()), pa.array(runs, pair), batch.column(3).slice(low, 256)], names=names)

    keyed = _keyed(full, plain)
    narrow = keyed.select("doc_id", _key().alias("key"), F.col("text").cast("binary").alias("text"), "others")
    rest = narrow.mapInArrow(untouched, schema)

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.flatnonzero(holds(seen, np.asarray(batch.column(3))))
            for low in range(0, len(keep), 256):
                yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(keep[low : low + 256])) for i in (0, 1, 2, 4, 5)], names=["doc_id", "id", "h", "text", "others"])

    wide = keyed.select("doc_id", "id", "h", _key().alias("key"), F.col("text").cast("binary").alias("text"), "others")
    hit = wide.mapInArrow(touched, f"doc_id bigint, id bigint, h bigint, text binary, others {extra}").join(by_doc, ["id", "h"], "left")
    return rest.unionAll(hit.select("doc_id", "text", "spans", "others").mapInArrow(cut, schema))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The documents, all of them, without the repeated stretches of their texts; ``n_chars`` follows where there is one."""
    keep = [c for c in docs.columns if c not in ("doc_id", "text")]
    text, others = F.col("kept").cast("string"), F.col("others")
    columns = {c: others[f"c{i}"] for i, c in enumerate(keep)} | {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": text}
    if "n_chars" in keep:
        columns["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return repeats(docs, keep, whole_characters=True).select(*(columns[c].alias(c) for c in docs.columns))


def _inward(text: bytes, start: int, end: int) -> tuple[int, int]:
    """The span without the parts of characters at its ends."""
    while start < end and text[start] & 0xC0 == 0x80:
        start += 1
    while start < end < len(text) and text[end] & 0xC0 == 0x80:
        end -= 1
    return start, end


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of what ``repeats`` gives."""
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
