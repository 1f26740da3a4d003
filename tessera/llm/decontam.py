"""Benchmark decontamination by spaced-seed hashing.

Words are runs of letters, digits and non-ASCII bytes, A-Z in lower case.  Four fixed masks of five words
ignore the positions between them; whatever three words of a stretch of twelve are substituted, one mask at
one place sees none of them, so every stretch of twelve words with at most three substitutions gives an equal
seed.  Items of 8 or 9 words, which may differ in two, get four more masks for the pairs of words that those
leave no seed beside; items of 1 to 7 words are one seed of all their words, and must stand in a text as they are.

1. The items' seeds are a table.  A bitmap of fixed size spares texts' seeds that no item can have; the others are
   joined with it, and every (document, item, diagonal) that meets is kept once.
2. The words of the documents that met an item are joined with the items' words, a diagonal at a time, and compared.

A document is contaminated by an item where some ``STRETCH`` consecutive aligned words have at
most ``SUBSTITUTIONS`` differences; an item of 8 to 11 words must match as a whole, with a quarter of its words
different at most.  Nothing of either side is collected: both may be of any size.

Defined results: null and empty texts are never contaminated; items that are null, or without words, take no
part; items equal in id and text are one; repeated rows of documents are judged each; very long texts are as others
(a task holds some 20 bytes for each of a text's bytes); other columns, whatever their names, are kept (``decontaminate``) or left out (``contaminated``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bitmap import bitmap, holds, rows_with
from tessera.llm.store import discard, materialise
from tessera.llm.textblocks import LOWER, apart_hashes, blocks, mix, powers, runs

#: Positions of a seed's words. Any three substitutions among twelve words leave one of these whole somewhere.
MASKS = ((0, 1, 2, 4, 5), (0, 1, 3, 7, 8), (0, 1, 4, 6, 7), (0, 1, 3, 4, 5))
#: With these too, any two substitutions in 8 or 9 words do; they are used where there are items so short.
SHORT_MASKS, SHORT_WORDS = ((0, 1, 2, 3, 4), (0, 1, 2, 3, 5), (0, 1, 2, 5, 6), (0, 2, 4, 5, 6)), 9
STRETCH, SUBSTITUTIONS, LEAST_WORDS = 12, 3, 8
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and the number of each text's first one."""
    starts, ends = runs(_WORD[data], offsets)
    return apart_hashes(data, starts, ends, LOWER), np.searchsorted(starts, offsets)


def masks_of(n: int) -> tuple[int, ...]:
    """The masks, by number, whose seeds an item of ``n`` words has; -n is the mask of n words without a gap."""
    if n < LEAST_WORDS:
        return (-n,)
    return tuple(range(len(MASKS) + len(SHORT_MASKS) * (n <= SHORT_WORDS)))


def _mask(number: int) -> tuple[int, ...]:
    return tuple(range(-number)) if number < 0 else (MASKS + SHORT_MASKS)[number]


def seeds(hashes: np.ndarray, number: int) -> np.ndarray:
    """A seed for each place at which the mask fits."""
    mask = _mask(number)
    n = max(0, len(hashes) - mask[-1])
    total = np.full(n, (number + 100) * 0x9E3779B1, np.uint64)
    for j, o in enumerate(mask):
        total += hashes[o : o + n] * powers(0x9E3779B97F4A7C15, 8)[j + 1]
    return mix(total)


def overlap(text: np.ndarray, item: np.ndarray, origin: int) -> tuple[int, int, int] | None:
    """(first word, words, equal ones) of the overlap of a text's words from ``origin`` on with an item's, if it is one."""
    low, high = max(origin, 0), min(origin + len(item), len(text))
    need = min(STRETCH, len(item))
    if high - low < need:
        return None
    allowed = SUBSTITUTIONS if need == STRETCH else need // 4 if need >= LEAST_WORDS else 0
    sums = np.concatenate([[0], np.cumsum(text[low:high] == item[low - origin : high - origin])])
    ok = np.flatnonzero(sums[need:] - sums[:-need] >= need - allowed)
    if not len(ok):
        return None
    x, y = int(ok[0]), int(ok[-1]) + need
    return low + x, y - x, int(sums[y] - sums[x])


def _words_of(table: DataFrame, keys: str) -> DataFrame:
    """The rows with ``words`` (array of hashes) in place of their last column, a text; rows without words go."""
    names = [f.split()[0] for f in keys.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in blocks(batch.column(len(names))):
                hashes, first = words(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(hashes.view(np.int64)))
                some = pa.array(np.flatnonzero(np.diff(first)))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(low, high - low).take(some) for i in range(len(names))), lists.take(some)], names=[*names, "words"])

    return table.mapInArrow(run, f"{keys}, words array<bigint>")


def _item_seeds(items: DataFrame) -> DataFrame:
    """(seed, item, at): every seed of every item, and where in the item it stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, own in zip(batch.column(0).to_pylist(), batch.column(1)):
                hashes = np.asarray(own.values).view(np.uint64)
                for number in masks_of(len(hashes)):
                    s = seeds(hashes, number)
                    yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(np.full(len(s), item)), pa.array(np.arange(len(s), dtype=np.int64))], names=["seed", "item", "at"])

    return items.select("item", "words").mapInArrow(run, "seed bigint, item bigint, at bigint")


def _meetings(docs: DataFrame, seeds_: DataFrame, numbers: list[int]) -> DataFrame:
    """(id, h, item, origin): the diagonals on which a document and an item have a seed in common."""
    seen = bitmap(seeds_, F.col("seed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, _, data, offsets in blocks(batch.column(2)):
                hashes, first = words(data, offsets)
                for number in numbers:
                    s = seeds(hashes, number)
                    at = np.flatnonzero(holds(seen, s))
                    text = np.searchsorted(first, at, "right") - 1
                    inside = at + _mask(number)[-1] < first[text + 1]
                    at, text = at[inside], text[inside]
                    if len(at):
                        some = pa.array(low + text)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(some), batch.column(1).take(some), pa.array(s[at].view(np.int64)), pa.array(at - first[text])], names=["id", "h", "seed", "pos"])

    hits = docs.mapInArrow(run, "id bigint, h bigint, seed bigint, pos bigint")
    return hits.join(seeds_, "seed").select("id", "h", "item", (F.col("pos") - F.col("at")).alias("origin")).distinct()


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("id"), F.xxhash64("text").alias("h"), "text")


def _overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """id, h, item_id, doc_word, n_words, n_equal: the best overlap of each document, by id and hash of the text, and item."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter("text is not null").distinct()
    items = materialise(_words_of(items, "item_id bigint").withColumn("item", F.monotonically_increasing_id()))
    sizes = [r["n"] for r in items.select(F.least(F.size("words"), F.lit(SHORT_WORDS + 1)).alias("n")).distinct().collect()]  # ten at most
    numbers = sorted({m for n in sizes for m in masks_of(n)})
    seeds_ = materialise(_item_seeds(items))
    met = materialise(_meetings(_keyed(docs), seeds_, numbers), compact=True)
    key = F.xxhash64("id", "h")
    texts = rows_with(_keyed(docs), key, bitmap(met, key)).dropDuplicates(["id", "h"])
    texts = _words_of(texts, "id bigint, h bigint").withColumnRenamed("words", "text_words")
    same = F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.h") == F.col("b.h"))
    pairs = met.alias("a").join(texts.alias("b"), same).select("a.*", "b.text_words").join(items.select("item", "item_id", "words"), "item")
    # only the text's words that the item's can stand beside
    begin = F.greatest("origin", F.lit(0))
    beside = F.slice("text_words", (begin + 1).cast("int"), F.size("words"))
    pairs = pairs.select("id", "h", "item_id", begin.alias("begin"), F.least("origin", F.lit(0)).alias("origin"), beside.alias("beside"), "words")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for i, (begin, origin) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())):
                got = overlap(np.asarray(batch.column(5)[i].values), np.asarray(batch.column(6)[i].values), origin)
                if got:
                    rows.append(i)
                    out.append((begin + got[0], *got[1:]))
            if rows:
                some = pa.array(rows)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(some) for i in range(3)), *(pa.array(c, pa.int64()) for c in zip(*out))], names=["id", "h", "item_id", "doc_word", "n_words", "n_equal"])

    found = pairs.mapInArrow(compare, "id bigint, h bigint, item_id bigint, doc_word bigint, n_words bigint, n_equal bigint")
    best = F.max_by(F.struct("doc_word", "n_words", "n_equal"), F.struct("n_equal", -F.col("doc_word"), F.col("n_words"))).alias("best")
    out = materialise(found.groupBy("id", "h", "item_id").agg(best).select("id", "h", "item_id", "best.*"), compact=True)
    discard(items, seeds_, met)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, doc_word (the overlap's first word), n_words, n_equal: one row a document and item that overlap."""
    found = _overlaps(docs, benchmark)
    key = F.xxhash64("id", "h")
    rows = rows_with(_keyed(docs), key, bitmap(found, key)).select("id", "h")
    same = F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.h") == F.col("b.h"))
    return rows.alias("a").join(found.alias("b"), same).select(F.col("a.id").alias("doc_id"), "item_id", "doc_word", "n_words", "n_equal")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that no item contaminates.  Only rows whose key's bit is set meet the table of those that go."""
    found = _overlaps(docs, benchmark).select("id", "h").distinct()
    seen = bitmap(found, F.xxhash64("id", "h"))
    key = F.xxhash64(docs["doc_id"].cast("bigint"), F.xxhash64(docs["text"]))
    hit = rows_with(docs, key, seen)
    same = hit["doc_id"].cast("bigint").eqNullSafe(found["id"]) & (F.xxhash64(hit["text"]) == found["h"])
    return rows_with(docs, key, seen, False).unionAll(hit.join(found, same, "left_anti"))
