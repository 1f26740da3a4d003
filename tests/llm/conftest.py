import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, h int, n int, score double, shard int, key string, tokens string, spans string"


def prose(rnd, n, words=400):
    return " ".join(rnd.choice([f"w{rnd.randrange(words)}", f"Wort{rnd.randrange(words)},", "the", "of", "Größe", "é"]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, white and long texts, ties, repeated rows, copies, near copies, shared passages."""
    rnd = random.Random(7)
    passage = prose(rnd, 60)
    base = [prose(rnd, rnd.choice([5, 30, 80, 200])) for _ in range(12)]
    texts = [*base, base[3], base[3], base[5].replace("the", "The", 1), base[6] + " tail", None, None, "", " \n\t", "one", "one two", "a" * 400, "ab " * 300, "x" + passage, passage + " y " + prose(rnd, 10), prose(rnd, 20) + passage, prose(rnd, 6000), "it's <|endoftext|> 日本語 \x00 'RE 12３", "İß ẞ ΟΔΟΣ"]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    rows += [rows[2], rows[2], (6, "same id, another text"), (None, base[1]), (None, None), (-5, base[2])]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame([(i, t, None if i == 3 else "en", "s", None, 1, 2, 0.5, 3, "k", "t", "s") for i, t in odd_rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
