"""A classifier of contents for files whose names tell nothing (S-13): multinomial naive Bayes by joins and sums.

``train`` counts words by class; ``classify`` joins a text's words with the counts and adds up logarithms.  A word that no class
has seen is left out; a word that only other classes have counts as seen once by smoothing.  What is the same for all words of
a class is added once a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.inverted import counted
from tessera.operators.lineage import cut
from tessera.operators.ranking import terms
from tessera.operators.search import small


def _words(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, word, n: a row for each word of a text."""
    found = rows.select(*keys, F.explode(terms(F.coalesce("text", F.lit("")))).alias("word"))
    return found.groupBy(*keys, "word").agg(F.count("*").alias("n"))


def train(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of texts (class, text): a row a word with its counts by class, and a row a class with the logarithms of its share and of its size.

    Texts without a class are left out.
    """
    rows = rows.filter("class is not null")
    counts = cut(_words(rows, "class"))
    words = cut(counts.groupBy("word").agg(F.collect_list(F.struct("class", F.log(F.col("n") + 1.0).alias("weight"))).alias("classes")))  # an entry a class
    vocabulary, texts = words.count(), rows.count()
    share = rows.groupBy("class").agg(F.log(F.count("*") / F.lit(texts)).alias("share"))
    size = counts.groupBy("class").agg(F.log(F.sum("n") + F.lit(vocabulary)).alias("size"))
    return words, cut(share.join(size, "class"))


def classify(rows: DataFrame, model: tuple[DataFrame, DataFrame], key: str = "id") -> DataFrame:
    """key and class of texts (key, text): the likeliest, of equal ones the first; a text without a known word is of the most frequent class."""
    words, classes = model
    listed = classes.orderBy("class").collect()  # a row a class
    if not listed:
        return rows.select(key, F.lit(None).cast("string").alias("class")).limit(0)
    of = F.map_from_entries("classes")
    weights = words.select("word", F.array(*[F.coalesce(F.try_element_at(of, F.lit(r["class"])), F.lit(0.0)) for r in listed]).alias("weights"))
    known = _counted(rows, key).join(small(weights), "word")
    # One row a text: a column for each class, as there are few of these.
    sums = known.groupBy(key).agg(F.sum("n").alias("_seen"), *(F.sum(F.col("n") * F.col("weights")[i]).alias(f"_gain{i}") for i in range(len(listed))))
    base = lambda r: F.lit(r["share"]) - F.coalesce("_seen", F.lit(0)) * F.lit(r["size"])
    rated = [F.struct((-F.round(base(r) + F.coalesce(f"_gain{i}", F.lit(0.0)), 6)).alias("less"), F.lit(r["class"]).alias("class")) for i, r in enumerate(listed)]
    return rows.select(key).distinct().join(sums, key, "left").select(key, F.array_min(F.array(*rated))["class"].alias("class"))


def _counted(rows: DataFrame, key: str) -> DataFrame:
    """key, word, n: the words of each text, counted where it is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 128):
                part = pa.table(batch.slice(low, 128).columns, names=["key", "words"])
                known, word, text, n = counted(part.column("words").combine_chunks())
                yield pa.RecordBatch.from_arrays([part.column("key").combine_chunks().take(pa.array(text)), known.take(pa.array(word)), pa.array(n)], names=[key, "word", "n"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, terms(F.coalesce("text", F.lit(""))).alias("words")).mapInArrow(run, f"`{key}` {kind}, word string, n int")


def filled(files: DataFrame, model: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Files (id, language, content, ...) with the languages that their names don't tell taken from their contents."""
    told = classify(files.filter("language is null").select("id", F.col("content").alias("text")), model).withColumnRenamed("class", "_told")
    return files.join(told, "id", "left").withColumn("language", F.coalesce("language", "_told")).select(*files.columns)
