"""Spelling variants against a plain-Python version, and the pieces they are made of."""

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import spelling


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_counts(rows, noise):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = lowered(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if noise and h % noise == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            n[word] += 1
    return n


def near(a, b):
    """Differ by exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows, noise, min_length=6, min_count=5, ratio=5):
    n = {w: c for w, c in plain_counts(rows, noise).items() if len(w) >= min_length and c >= min_count}
    around = {w: [v for v in n if near(v, w)] for w in n}
    form = {}
    for w, others in around.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(around[w]), n.get(form[w])))
    return out


def rows_of(df):
    return [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()]


@pytest.fixture(scope="module")
def corpus():
    """Words in families one edit apart, with counts of every ratio, ties, long words, letters of Latin-1, hot words."""
    rnd, rows, letters = random.Random(3), [], "abcdeéßÀ"
    words = ["".join(rnd.choice(letters) for _ in range(rnd.choice([5, 6, 6, 7, 7, 8, 12]))) for _ in range(40)]
    for word in list(words):
        for _ in range(6):
            at, kind = rnd.randrange(len(word) + 1), rnd.randrange(3)
            words.append(word[:at] + rnd.choice(letters) * (kind != 1) + word[at + (kind != 0) :])
    weights = [rnd.choice([1, 1, 5, 6, 30, 160, 800]) for _ in words]
    for i in range(120):
        chosen = rnd.choices(words, weights, k=rnd.choice([0, 5, 60, 400]))
        rows.append((i, " ".join(w.upper() if rnd.random() < 0.1 else w for w in chosen) + "123x"))
    rows += [(7, rows[7][1]), (None, rows[3][1]), (5, None), (6, ""), (8, "12 34 !"), (9, "l" * 70_000 + " " + ("m" * 50_000 + " ") * 6), (10, ("m" * 50_001 + " ") * 40)]
    return rows


@pytest.mark.parametrize("noise", [None, 3])
def test_equals_plain_version(spark, corpus, noise):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in corpus], "doc_id bigint, text string, n int, word string").repartition(5)
    got = rows_of(spelling.spelling_variants(docs, noise=noise))
    want = plain_variants(corpus, noise)
    assert len(got) == len(want) and set(got) == want
    assert sum(form is not None for _, form, *_ in want) > 10 and sum(root != (form or word) for word, form, root, *_ in want) > 0


def test_counts_in_many_small_tables(spark, corpus, monkeypatch):
    rows = [(i, t) for i, t in corpus if len(t or "") < 9_000]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = plain_counts(rows, 199)
    for limit in (1, 1 << 30):
        monkeypatch.setattr(spelling, "HELD_WORDS", limit)  # the function's closure carries it to the workers
        assert {r["word"]: r["n"] for r in spelling.counted(docs, 199).collect() if r["word"]} == {w: n for w, n in want.items() if w}


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert spelling.spelling_variants(empty).count() == 0
    assert spelling.spelling_variants(spark.createDataFrame([(1, None), (None, "short words")], "doc_id bigint, text string")).count() == 0


def test_bands_flip_as_edits_do(spark):
    pairs = [("letter", "latter", 2), ("letter", "letters", 1), ("éàü", "éàûü", 1), ("aaaa", "aa", 0), ("ÿz", "zÿ", 0), ("a÷", "a×", 2)]
    rows = spark.createDataFrame(pairs, "a string, b string, flips int").select("flips", spelling._bands(F.col("a")).alias("a"), spelling._bands(F.col("b")).alias("b")).collect()
    for flips, a, b in rows:
        assert sum((x ^ y).bit_count() for x, y in zip(a, b)) == flips and len(a) == spelling.BANDS and max(*a, *b) < 1 << 30


@settings(max_examples=12, deadline=None)
@given(st.sets(st.text(alphabet="abé", min_size=1, max_size=7), min_size=2, max_size=60))
def test_all_near_pairs_once(spark, words):
    rows = spark.createDataFrame([(w, 5) for w in words], "word string, n bigint")
    got = [frozenset((r["word"], r["other"])) for r in spelling.near_pairs(rows).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {frozenset((a, b)) for a in words for b in words if a < b and near(a, b)}


def test_long_ways_are_followed(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(13)], "word string, form string")
    for steps in (13, 14, 16, 27):
        assert {r["root"] for r in spelling.roots(forms, steps).collect()} == {"w13"}


def test_one_band_does_not_meet_itself(spark):
    """Anagrams share mask and length: an equal half, not the band alone, brings words together."""
    rnd = random.Random(5)
    words = {"".join(rnd.sample("abcdefghij", 10)) for _ in range(4_000)}
    rows = spark.createDataFrame([(w, 5) for w in words], "word string, n bigint")
    pairs = spelling.near_pairs(rows)
    assert pairs.count() == 0
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Python" not in plan
