"""Decontamination by items of 8 to 12 words: every placement of the substitutions that they may have."""

import random
import re
from itertools import combinations

import pytest

from tessera.llm import decontam


def found(spark, items, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    return {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, bench).collect()}


@pytest.mark.parametrize("n, allowed", [(8, 2), (9, 2), (10, 2), (11, 2), (12, 3)])
def test_every_placement_is_found(spark, n, allowed):
    item = [f"w{i}" for i in range(n)]
    for k in range(allowed + 2):
        texts = [" ".join(["before", *(f"x{i}" if i in gone else w for i, w in enumerate(item)), "after"]) for gone in combinations(range(n), k)]
        # other items stand around the short one, so that masks must not reach over its ends
        got = found(spark, ["a b c d e f g h i j k l m", " ".join(item), "one two three four five six seven eight"], texts)
        assert got == ({(t, 1) for t in range(len(texts))} if k <= allowed else set())


def test_long_items_need_no_more_masks():
    assert decontam.masks_of(20) == tuple(range(len(decontam.MASKS)))
    assert decontam.masks_of(7) == (-7,)


def brute(text, item):
    """Whether any alignment of the words has a stretch that is similar enough."""
    t, i = ([w.lower() for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", x or "")] for x in (text, item))
    need = min(12, len(i))
    allowed = 3 if need == 12 else need // 4 if need >= 8 else 0
    for origin in range(-len(i), len(t) + 1):
        low, high = max(origin, 0), min(origin + len(i), len(t))
        equal = [t[k] == i[k - origin] for k in range(low, high)]
        if need and any(sum(equal[k : k + need]) >= need - allowed for k in range(len(equal) - need + 1)):
            return True
    return False


def test_against_all_alignments(spark):
    rnd = random.Random(3)
    vocabulary = [f"w{k}" for k in range(60)]
    some = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [" ".join(some(rnd.choice([1, 2, 3, 5, 6, 7, 8, 9, 10, 11, 12, 13, 30]))) for _ in range(25)] + ["what is the capital of france", "", None, "a,b,c,d,e,f,g,h,i,j"]
    texts = [None, "", "!", "What is the capital of France?", "a b c d e f g x y j"]
    for _ in range(150):
        words = some(rnd.choice([0, 4, 20, 60]))
        item = (rnd.choice(items) or "").split()
        for k in range(len(item)):
            if rnd.random() < 0.2:
                item[k] = rnd.choice(vocabulary)
        at = rnd.randrange(len(words) + 1)
        texts.append(" ".join(words[:at] + item + words[at:]))
    assert found(spark, items, texts) == {(d, i) for d, t in enumerate(texts) for i, x in enumerate(items) if brute(t, x)}


def test_many_items_of_one_template(spark):
    template = "please read the question with care and then choose the one best answer".split()
    items = [" ".join([*template, f"q{k}", f"r{k}"]) for k in range(2_000)]
    texts = ["so " + " ".join(template) + " now", "nothing of the kind", " ".join(template[:8])]
    assert found(spark, items, texts) == {(0, k) for k in range(2_000)}


def test_a_very_long_text(spark):
    item = " ".join(f"x{k}" for k in range(14))
    long = "wort " * 6_000_000 + item
    docs = spark.createDataFrame([(1, long), (2, "wort " * 10)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(5, item)], "item_id bigint, text string")
    assert [(r["doc_id"], r["doc_word"], r["n_equal"]) for r in decontam.contaminated(docs, bench).collect()] == [(1, 6_000_000, 14)]
    assert [r["doc_id"] for r in decontam.decontaminate(docs, bench).select("doc_id").collect()] == [2]
