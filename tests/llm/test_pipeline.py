"""Each stage of the pipeline against a plain-Python version, on what its predecessor kept."""

import math
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import toxicity
from tessera.llm.store import materialise
from tests.llm.test_brute import plain_terms
from tests.llm.test_short_items import brute as aligned

RND = random.Random(21)
WORDS = [f"w{k}" for k in range(400)] + ["Größe", "été", "niño", "日本"]


def prose(n):
    return " ".join(RND.choice(WORDS) for _ in range(n))


def rows():
    passage, template = prose(60), prose(30)
    items = [prose(20), prose(12), prose(9), prose(5)]
    texts = [prose(RND.choice([3, 20, 60, 150])) for _ in range(40)]
    texts += [texts[0], texts[5], texts[5], texts[7] + " end", texts[9].replace("w1 ", "x1 ", 1), texts[11] + " a b c"]  # copies, near copies
    texts += [prose(30) + " " + passage + " " + prose(10) for _ in range(4)] + ["é" + passage, passage + passage]  # shared passages
    texts += [prose(20) + " " + RND.choice(items) + " " + prose(5) for _ in range(6)]  # benchmark passages
    texts += [f"you vile stupid {prose(5)} idiot scum {RND.choice(['hate', 'trash'])}" for _ in range(12)]
    texts += [None, "", " \n", "one", template, template + " x", prose(3_000)]
    return [(i * 2, t, "en", len(t) if t is not None else None) for i, t in enumerate(texts)], list(enumerate(items))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("corpus"))
    docs, items = rows()
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, n_chars bigint").repartition(5).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    labels = [(i, 1, int("stupid" in (t or ""))) for i, t, *_ in docs if i % 3]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def words(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def without_near_copies(docs):
    sets, kept = {i: shingles(t) for i, t in docs.items()}, set()
    for i in sorted(docs):
        if not sets[i]:
            kept.add(i)
            continue
        seen, todo = {i}, [i]
        while todo:
            a = todo.pop()
            for b in docs:
                if b not in seen and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    seen.add(b)
                    todo.append(b)
        if min(seen) == i:
            kept.add(i)
    return {i: docs[i] for i in kept}


def without_repeats(docs):
    seen, out = set(), {}
    for i in sorted(docs):
        raw = (docs[i] or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for s in range(len(raw) - 99):
            if raw[s : s + 100] in seen:
                gone[s : s + 100] = True
            seen.add(raw[s : s + 100])
        # runs whose ends cut a character give its bytes back
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int)])))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            while a < b and raw[a] & 0xC0 == 0x80:
                gone[a], a = False, a + 1
            while a < b < len(raw) and raw[b] & 0xC0 == 0x80:
                b -= 1
                gone[b] = False
        out[i] = bytes(b for b, g in zip(raw, gone) if not g).decode()
    return out


def test_stages_equal_plain_ones(spark, folder):
    docs, (first, second, third, fourth, last) = spark.read.parquet(f"{folder}/documents.parquet"), [f for _, f in corpus_pipeline.STAGES]
    items = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    texts = lambda frame: {r["doc_id"]: r["text"] for r in frame.collect()}

    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    hashes = {int(h): w for t in texts(docs).values() for w in plain_terms((t or "").encode())[0] for h in term_hash(w)}
    assert {int(h) for h in model.vocabulary} <= set(hashes)

    def toxic(text):
        counts, n = plain_terms((text or "").encode())
        total = model.bias
        for k, h in enumerate(model.vocabulary.tolist()):
            times = counts[hashes[h]]
            reached = 0 if not times else 1 + (times >= 2 and times * 400 >= n) + (times >= 2 and times * 100 >= n)
            total += model.weights[k * toxicity.LEVELS : k * toxicity.LEVELS + reached].sum()
        return 1 / (1 + math.exp(-total)) >= 0.5

    at = materialise(first(spark, docs, folder))
    clean = {i: t for i, t in texts(docs).items() if not toxic(t)}
    assert texts(at) == clean and len(clean) < docs.count() and at.columns == docs.columns
    before, at = texts(at), materialise(second(spark, at, folder))
    assert texts(at) == without_near_copies(before) and at.columns == docs.columns
    before, at = texts(at), materialise(third(spark, at, folder))
    assert texts(at) == without_repeats(before) and at.columns == docs.columns
    assert any(texts(at)[i] != (before[i] or "") for i in before)
    assert all(r["n_chars"] == len(r["text"]) for r in at.collect())
    before, at = texts(at), materialise(fourth(spark, at, folder))
    assert texts(at) == {i: t for i, t in before.items() if not any(aligned(t, x) for x in items)} and len(texts(at)) < len(before)
    pieces = last(spark, at, folder).collect()
    assert {r["doc_id"] for r in pieces} == set(texts(at)) and sum(r["length"] for r in pieces) == sum(r["doc_tokens"] for r in pieces if r["start"] == 0)
    whole = corpus_pipeline.run(spark, folder).collect()
    plain = lambda found: sorted((r["doc_id"], r["start"], r["length"], bytes(r["ids"]), r["doc_tokens"]) for r in found)
    assert plain(whole) == plain(pieces)


def term_hash(term):
    """The hash of one term: of a word, or of a beginning (word, length)."""
    word, n = term if isinstance(term, tuple) else (term, 0)
    got = toxicity.apart_hashes(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]), np.arange(256, dtype=np.uint8))
    return got + np.uint64(n)
