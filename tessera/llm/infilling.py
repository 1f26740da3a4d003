"""Fill-in-middle transformation: documents rearranged so that a model learns to fill a gap.

A text is cut into tokens - runs of A-Z and a-z, and every other code point alone - and two cuts between tokens, drawn
from a hash of the id, part it into prefix, middle and suffix.  The scan is a finite automaton over UTF-8 bytes with
two states, within a run of letters or not.  A stretch of bytes maps the state before it to the state after it and,
for each state before it, to the number of tokens that begin in it.  Such maps compose associatively, so the
stretches of a giant document are scanned by many tasks that don't know what stands before them; composing their maps
gives the state and the count with which each is entered, and the two stretches that hold the cuts are read again to
select them.  A text of one stretch is scanned, cut and rearranged where it is read, without any shuffle.

Defined results: a null text is an empty one; a null id is hashed as an empty string; repeated rows are kept, each with the same
result; an empty table gives no rows; giant texts are found by their size, and no task scans more than a stretch of one,
though its rearranged text is one row again; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.store import materialise
from tessera.llm.textblocks import blocks, release

#: Bytes of a stretch: a giant text has more.
STRETCH = 1 << 16
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
SCHEMA = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
CUT_UP, SELECTED = "key string, number int, data binary", "key string, second int, bytes bigint, chars bigint"
MAPS = "key string, number int, size bigint, chars bigint, exits array<int>, tokens array<bigint>"
_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64())}


def one_row(schema: str, *values) -> pa.RecordBatch:
    fields = [field.split() for field in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], _ARROW[kind]) for v, (_, kind) in zip(values, fields)], names=[name for name, _ in fields])


def begins(data: np.ndarray, inside: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(where a token begins, where a code point begins) in bytes entered within a run of letters or not."""
    letter, lead = _LETTER[data], (data & 0xC0) != 0x80
    before = np.concatenate([[inside], letter[:-1]])[: len(data)]
    return lead & ~(letter & before), lead


class Draw:
    """What the hash of an id decides."""

    def __init__(self, doc_id: int | None, seed: int):
        hexes = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        self.h1, self.h2, self.h3, self.h4 = (int(hexes[i : i + 8], 16) for i in range(0, 32, 8))

    def cuts(self, n: int) -> tuple[int, int]:
        return min(self.h1 % (n + 1), self.h2 % (n + 1)), max(self.h1 % (n + 1), self.h2 % (n + 1))

    def form(self, text: bytes, changed: int, spm: int) -> str:
        if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or self.h3 % 100 >= changed:
            return "plain"
        return "spm" if self.h4 % 100 < spm else "psm"


def rearranged(text: bytes, form: str, first: int, second: int) -> bytes:
    """The text with its parts before, between and after the two byte positions in the form's order."""
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if form == "psm":
        return b"".join([PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle])
    return b"".join([SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle]) if form == "spm" else text


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from: no part of a rearranged text holds a mark."""
    parts = F.split(output, "<[PSM]>")
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def fill_in_middle(docs: DataFrame, seed: int = 1, changed: int = 90, spm: int = 20, stretch: int = STRETCH) -> DataFrame:
    """doc_id, n (tokens), form, prefix_chars, middle_chars (null where plain) and output of every document.

    ``changed`` of a hundred documents are rearranged, ``spm`` of a hundred of these with the suffix first.
    """
    docs = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    giant = F.octet_length("text") > stretch

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        columns = [pa.array(column, pa.binary() if i == 5 else kind).cast(kind) for i, (column, kind) in enumerate(zip(zip(*rows), kinds))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    def row(doc_id, n, text: bytes, form: str, first: tuple[int, int], second: tuple[int, int]) -> tuple:
        """``first`` and ``second``: (bytes, code points) before the cuts."""
        chars = (None, None) if form == "plain" else (first[1], second[1] - first[1])
        return (doc_id, n, form, *chars, rearranged(text, form, first[0], second[0]))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in blocks(batch.column(1)):
                token, lead = begins(data)
                inner = offsets[:-1][np.diff(offsets) > 0]
                token[inner] = True  # a text begins outside of any run
                at, chars = np.flatnonzero(token), np.concatenate([[0], np.cumsum(lead)])
                number, raw, rows = np.searchsorted(at, offsets), data.tobytes(), []
                for i, doc_id in enumerate(batch.column(0).slice(low, high - low).to_pylist()):
                    a, b, n = int(offsets[i]), int(offsets[i + 1]), int(number[i + 1] - number[i])
                    draw, text = Draw(doc_id, seed), raw[a:b]
                    where = [int(at[number[i] + t]) if t < n else b for t in draw.cuts(n)]
                    rows.append(row(doc_id, n, text, draw.form(text, changed, spm), *((w - a, int(chars[w] - chars[a])) for w in where)))
                yield batch_of(rows)
            release()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                raw = memoryview(text.as_buffer())
                for number, a in enumerate(range(0, len(raw), stretch)):
                    yield one_row(CUT_UP, key, number, bytes(raw[a : a + stretch]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The map of each stretch: state after it and tokens in it, entered outside (0) or inside (1) of a run."""
        for batch in batches:
            for key, number, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data = np.frombuffer(raw.as_buffer(), np.uint8)
                (outside, lead), (inside, _) = begins(data), begins(data, True)
                after = int(_LETTER[data[-1]])
                yield one_row(MAPS, key, number, len(data), int(lead.sum()), [after, after], [int(outside.sum()), int(inside.sum())])

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = [Draw(d, seed).cuts(n) for d, n in zip(*(batch.column(i).to_pylist() for i in (1, 2)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in cuts], pa.int64()), pa.array([b for _, b in cuts], pa.int64())], names=["key", "first", "second"])

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Bytes and code points before token ``cut`` of the document, from the stretch that holds it."""
        for batch in batches:
            key, second, token, entry, size, chars, data = (batch.column(i) for i in range(7))
            for i in range(batch.num_rows):
                begin, lead = begins(np.frombuffer(data[i].as_buffer(), np.uint8), bool(entry[i].as_py()))
                at = int(np.flatnonzero(begin)[token[i].as_py()])
                yield one_row(SELECTED, key[i].as_py(), second[i].as_py(), size[i].as_py() + at, chars[i].as_py() + int(lead[:at].sum()))

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_id, text, n, *places = (batch.column(i) for i in range(7))
            for i in range(batch.num_rows):
                raw, d = text[i].as_buffer().to_pybytes(), doc_id[i].as_py()
                where = [x[i].as_py() for x in places]
                yield batch_of([row(d, n[i].as_py(), raw, Draw(d, seed).form(raw, changed, spm), tuple(where[:2]), tuple(where[2:]))])
            release()

    out = docs.filter(~giant).mapInArrow(short, SCHEMA)
    # A giant text's key tells its id and text, so that rows of one key have one result.
    giants = docs.filter(giant).withColumn("key", F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"), 256))
    stretches = giants.select("key", "text").mapInArrow(cut_up, CUT_UP).repartition("key", "number")
    stretches = materialise(stretches.dropDuplicates(["key", "number"]))
    maps = stretches.mapInArrow(scan, MAPS)
    # Every stretch has bytes, so its map gives one state for either entry: composed with all before it, it is entered as the one before is left.
    order = Window.partitionBy("key").orderBy("number")
    entry = F.coalesce(F.lag(F.col("exits")[0]).over(order), F.lit(0))
    entered = maps.select("key", "number", "size", "chars", entry.alias("entry"), F.col("tokens")[entry].alias("tokens"))
    before = lambda c: (F.sum(c).over(order) - F.col(c)).alias(f"before_{c}")
    entered = materialise(entered.select("*", *map(before, ("tokens", "size", "chars"))))
    composed = entered.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("tokens", "size", "chars"))).withColumnRenamed("tokens", "n")
    ids = giants.select("key", "doc_id").dropDuplicates(["key"])
    cuts = composed.select("key", "n").join(ids, "key").select("key", "doc_id", "n").mapInArrow(drawn, "key string, first bigint, second bigint")
    asked = cuts.select("key", F.posexplode(F.array("first", "second")).alias("second", "cut"))
    held = asked.join(entered, "key").withColumn("token", F.col("cut") - F.col("before_tokens")).filter("token >= 0 and token < tokens")
    held = held.join(stretches, ["key", "number"]).select("key", "second", "token", "entry", "before_size", "before_chars", "data")
    found = held.mapInArrow(select, SELECTED)
    where = found.groupBy("key").pivot("second", [0, 1]).agg(F.first("bytes").alias("bytes"), F.first("chars").alias("chars"))
    # A cut behind the last token is in no stretch.
    ends = composed.join(where, "key", "left").select("key", "n", *(F.coalesce(f"{i}_{c}", e).alias(f"c{i}_{c}") for i in (0, 1) for c, e in (("bytes", "size"), ("chars", "chars"))))
    long = giants.join(ends, "key").select("doc_id", "text", "n", "c0_bytes", "c0_chars", "c1_bytes", "c1_chars")
    return out.unionAll(long.mapInArrow(join_up, SCHEMA))
