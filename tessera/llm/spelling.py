"""Spelling variant grouping: words one edit apart are found by bands of letter-parity masks.

A word's mask has one bit a letter of the alphabet: set if the letter occurs an odd number of times.  One inserted
or deleted letter flips one bit, a replaced one two, so of three bands of the mask at least one is equal in two words
one edit apart.  Words meet in joins on an equal band.  A band of short words has few values, so a vocabulary of
millions would meet itself; the join therefore asks for more that any edit leaves equal: the length of the shorter
word, and its first half (an edit further back) or what follows it (an edit within the first half).  Each pair is
kept under the first of its equal keys alone, so nothing is emitted twice and no distinct follows, and is verified
by its masks, then letter by letter.

Words are counted where their texts are read, text by text and then task by task in tables of bounded size; the
shuffle gets partial counts.  Each word follows its form - its near word of largest count, if that count is ``ratio``
times its own - and forms are followed to the last by pointer doubling: counts grow by the ratio with every step, so
the longest way is known from the largest count.

Defined results: a null, empty or letterless text has no words; a null id is written as nothing in the noise's hash; repeated rows
count again; ties among forms go to the smallest word in code-point order; an empty table gives no rows; a very long
text is scanned match by match and holds its distinct words only; other columns are left out.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import materialise
from tessera.llm.textblocks import release

#: Runs of A-Z, a-z and U+00C0 to U+00FF in UTF-8, once A-Z are lower-cased.
_RUN = re.compile(rb"((?:[a-z]|\xc3[\x80-\xbf])+)")
#: A task's table of counts is handed on beyond so many words or bytes.
HELD_WORDS, HELD_BYTES = 200_000, 16 << 20
#: a-z by how common they are, so that the bands, which take letters in turn, tell about equally much.
_COMMON = "etaoinshrdlcumwfgypbvkjxqz"
BANDS = 3


def counted(docs: DataFrame, noise: int | None = None) -> DataFrame:
    """(word, n): every lower-cased run of letters and how often it occurs in all texts.

    ``noise`` plants misspellings, by which a corpus can measure the operator: where ``noise`` divides the crc32 h of
    ``<doc_id>:<word>``, code point h mod length goes from the word in that document.
    """

    def rows(held: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1).cast(pa.binary())):
                own = Counter(map(itemgetter(1), _RUN.finditer((text.as_py() or b"").lower())))
                salt = zlib.crc32(f"{'' if doc_id.as_py() is None else doc_id.as_py()}:".encode())
                for word, n in own.items():
                    if noise and (h := zlib.crc32(word, salt)) % noise == 0:
                        letters = word.decode()
                        at = h % len(letters)
                        word = (letters[:at] + letters[at + 1 :]).encode()
                    if word not in held:
                        held[word] = 0
                        size += len(word)
                    held[word] += n
                if len(held) >= HELD_WORDS or size >= HELD_BYTES:
                    yield rows(held)
                    held, size = {}, 0
        yield rows(held)
        release()

    partial = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text").mapInArrow(run, "word string, n bigint")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


def _bands(word: Column) -> Column:
    """The word's letter parities as an array of three 30-bit numbers."""

    def number(letter: Column) -> Column:
        return F.when(letter <= "z", F.instr(F.lit(_COMMON), letter) - 1).otherwise(F.ascii(letter) - 0xC0 + len(_COMMON))

    def flip(masks: Column, letter: Column) -> Column:
        at = number(letter)
        bit = F.call_function("shiftleft", F.lit(1), F.floor(at / BANDS).cast("int"))
        return F.transform(masks, lambda mask, band: F.when(at % BANDS == band, mask.bitwiseXOR(bit)).otherwise(mask))

    return F.aggregate(F.split(word, ""), F.array(*[F.lit(0)] * BANDS), flip)


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n), once a pair: words that differ by exactly one inserted, deleted or replaced letter."""
    masked = words.select("word", "n", F.length("word").alias("size"), _bands(F.col("word")).alias("bands"))

    def keyed(shorter: Column) -> DataFrame:
        """A row for each band and half of the word as one of a pair whose shorter word has so many letters."""
        half = F.floor(shorter / 2).cast("int")
        tail = (shorter - half).cast("int")
        halves = F.array(F.substr("word", F.lit(1), half), F.substr("word", F.col("size") - tail + 1, tail))
        rows = masked.select("*", shorter.alias("shorter"), halves.alias("halves"))
        rows = rows.select("*", F.posexplode("bands").alias("band", "value"))
        return rows.select("*", F.posexplode("halves").alias("half", "letters"))

    left = keyed(F.col("size"))
    right = left.unionAll(keyed(F.col("size") - 1)).filter("shorter > 0").toDF(*(f"o_{c}" for c in left.columns))
    keys = ("shorter", "band", "value", "half", "letters")
    a, b = [F.col("bands")[i] for i in range(BANDS)], [F.col("o_bands")[i] for i in range(BANDS)]
    earlier = [(F.col("band") > i) & (x == y) for i, (x, y) in enumerate(zip(a, b))]
    flips = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b)), F.lit(0))
    met = (
        (F.col("size") < F.col("o_size")) | (F.col("word") < F.col("o_word")),
        ~(earlier[0] | earlier[1] | earlier[2]),
        (F.col("half") == 0) | (F.col("halves")[0] != F.col("o_halves")[0]),
        flips == F.when(F.col("size") == F.col("o_size"), 2).otherwise(1),
        F.levenshtein("word", "o_word", 1) == 1,
    )
    on = [F.col(k) == F.col(f"o_{k}") for k in keys]
    for condition in met:
        on.append(condition)
    return left.join(right, on).select("word", "n", F.col("o_word").alias("other"), F.col("o_n").alias("other_n"))


def roots(forms: DataFrame, steps: int) -> DataFrame:
    """(word, root) of rows (word, form): the last word of each one's way, which has ``steps`` steps at most."""
    way = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(steps - 1, 0).bit_length()):
        on = way.select(F.col("word").alias("root"), F.col("root").alias("next"))
        way = way.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return way


def spelling_variants(docs: DataFrame, min_length: int = 6, min_count: int = 5, ratio: int = 5, noise: int | None = None) -> DataFrame:
    """word, n, form, form_n, root and n_near of every word of ``min_length`` letters or more that occurs ``min_count`` times."""
    words = materialise(counted(docs, noise).filter((F.length("word") >= min_length) & (F.col("n") >= min_count)))
    pairs = materialise(near_pairs(words))
    both = pairs.unionAll(pairs.select("other", "other_n", "word", "n"))
    best = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best"))
    best = best.select("word", "n", "n_near", F.when(-F.col("best.less") >= ratio * F.col("n"), F.struct("best.form", (-F.col("best.less")).alias("n"))).alias("best"))
    best = materialise(best.select("word", "n_near", F.col("best.form").alias("form"), F.col("best.n").alias("form_n")), compact=True)
    # A step multiplies the count by the ratio, or adds one where the ratio is one.
    most, steps = words.agg(F.max("n")).first()[0] or 0, 0
    least = max(min_count, 1)
    while least < most:
        least, steps = max(least * ratio, least + 1), steps + 1
    way = roots(best.filter("form is not null"), steps)
    out = words.join(best, "word", "left").join(way, "word", "left")
    return out.select("word", "n", "form", "form_n", F.coalesce("root", "word").alias("root"), F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"))
