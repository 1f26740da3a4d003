"""The classifier of contents: held-out accuracy, against plain naive Bayes, odd texts."""

import math
import random
import re
from collections import Counter

import duckdb

from tessera.plans import registry
from tessera.operators import indexing
from tessera.sources import content_model

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").fetchall())
    got = [(r["id"], r["language"]) for r in registry.QUERIES["content_languages"](spark, SF).filter("held_out").collect()]
    assert len(got) > 100 and sum(lang[i] == told for i, told in got) / len(got) > 0.9


def plain(train, texts):
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    counts, share = {}, Counter(c for c, _ in train if c is not None)
    for c, t in train:
        if c is not None:
            counts.setdefault(c, Counter()).update(words(t))
    known = {w for x in counts.values() for w in x}
    total = sum(share.values())
    out = {}
    for i, t in texts:
        mine = [w for w in words(t) if w in known]
        score = {c: math.log(share[c] / total) + sum(math.log(x[w] + 1) for w in mine) - len(mine) * math.log(sum(x.values()) + len(known)) for c, x in counts.items()}
        out[i] = min(score, key=lambda c: (-round(score[c], 6), c))
    return out


def test_equals_plain_naive_bayes(spark):
    rnd = random.Random(6)
    vocabulary = {"a": "ab cd ef gh the", "b": "ij kl mn gh the", "c": "op ab ij the"}
    text = lambda c: " ".join(rnd.choices(vocabulary[c].split(), k=rnd.randrange(1, 9))).title()
    train = [(c, text(c)) for c in rnd.choices("abc", [5, 3, 1], k=80)] + [(None, "ab ab ab"), ("a", None)]
    texts = [(i, text(rnd.choice("abc"))) for i in range(60)] + [(100, None), (101, ""), (102, "nothing known"), (103, "the the")]
    model = content_model.train(spark.createDataFrame(train, "class string, text string"))
    rows = spark.createDataFrame(texts, "id bigint, text string")
    assert {r["id"]: r["class"] for r in content_model.classify(rows, model).collect()} == plain(train, texts)
    files = spark.createDataFrame([(1, "Go", "ij kl mn"), (2, None, "ij kl mn"), (3, None, "ef ab cd")], "id bigint, language string, content string")
    assert {r["id"]: r["language"] for r in content_model.filled(files, model).collect()} == {1: "Go", 2: "b", 3: "a"}
    assert content_model.classify(rows.limit(0), model).count() == 0


def test_index_fills_in_languages(spark, tmp_path):
    model = content_model.train(spark.createDataFrame([("Go", "func package defer"), ("Python", "def import self")], "class string, text string"))
    rows = [("a.py", b"def x(self): import y\n" * 40), ("tool", b"func main() { defer package }\n" * 40)]
    docs = spark.createDataFrame(rows, "path string, content binary")
    indexing.index(docs, str(tmp_path), "p", "s", "v", classify=lambda files: content_model.filled(files, model))
    assert {r["path"]: r["language"] for r in spark.read.parquet(f"{tmp_path}/files").select("path", "language").collect()} == {"a.py": "Python", "tool": "Go"}
