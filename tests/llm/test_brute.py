"""Plain-Python versions of sharding, the classifiers' features, scores and fits, and very long texts through the classifiers."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import quality, sharding, toxicity
from tessera.llm.toxicity import LEVELS, ToxicityModel, swap_identities


def feistel(x, n, seed):
    a, b = sharding.grid(n)
    half = lambda k, r: int(hashlib.md5(f"{seed}:{r}:{k}".encode()).hexdigest()[:12], 16)
    while True:
        left, right = divmod(x, b)
        for r in range(sharding.ROUNDS):
            if r % 2 == 0:
                left = (left + half(right, r)) % a
            else:
                right = (right + half(left, r)) % b
        x = left * b + right
        if x < n:
            return x


def test_places_equal_a_plain_feistel_network(spark, odd_docs):
    for seed, docs in ((0, odd_docs.filter("doc_id is not null").dropDuplicates(["doc_id"])), (9, spark.range(1_003).selectExpr("id * 7 as doc_id", "string(id) as text"))):
        got = sharding.shard_documents(docs, 5, seed).collect()
        n = len(got)
        for row, r in enumerate(sorted(got, key=lambda r: (r["doc_id"], r["text_crc32"]))):
            place = feistel(row, n, seed)
            assert (r["shard"], r["slot"]) == (place % 5, place // 5)


TEXTS = ["", "One two, two.\nThree | four!\n\nOne two, two.", "a" * 20 + " B C 12", "ÄÖ ä é\té\n", " ".join(random.Random(1).choice(["go", "Gone", "x1", "WOW!", "the\n"]) for _ in range(300))]


def plain_features(text):
    raw = text.encode()
    words = re.findall(rb"[^\x20\x09-\x0d]+", raw)
    low = [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words]
    lines = [bytes(b + 32 if 65 <= b <= 90 else b for b in x) for x in raw.split(b"\n") if x]
    n, size = len(words), max(sum(map(len, words)), 1)
    if not n:
        return [0.0] * len(quality.FEATURES)
    share = lambda kind: sum(bool(kind[b]) for b in raw) / size
    grams = [tuple(low[i : i + 3]) for i in range(max(n - 2, 1))]
    out = {
        "log_words": math.log1p(n), "mean_word_bytes": sum(map(len, words)) / n, "long_words": sum(len(w) > 14 for w in words) / n,
        **{name: share(kind) for name, kind in quality._KINDS.items()},
        "lines": len(lines) / n, "line_words": n / max(len(lines), 1), "distinct_words": len(set(low)) / n, "commonest_word": max(Counter(low).values()) / n,
        "repeated_next": sum(a == b for a, b in zip(low, low[1:])) / n, "distinct_trigrams": len(set(grams)) / len(grams), "distinct_lines": len(set(lines)) / max(len(lines), 1),
    }
    return [out[f] for f in quality.FEATURES]


def block(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])


def test_features_equal_plain_ones():
    assert quality.features(*block(TEXTS)) == pytest.approx(np.array([plain_features(t) for t in TEXTS]))


def test_quality_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(3)
    x = rng.random((400, len(quality.FEATURES)))
    y = (x[:, 2] + x[:, 5] * x[:, 7] > 0.8).astype(float)
    model = quality.fit(x, y)
    got = model.score(x)
    for row, score in zip(x[:50], got):
        total = model.base
        for f, (edges, table) in enumerate(zip(model.edges, model.tables)):
            total += table[sum(row[f] >= e for e in edges)]
        for (a, b), table in zip(model.pairs, model.pair_tables):
            total += table[sum(row[a] >= e for e in model.pair_edges[a]), sum(row[b] >= e for e in model.pair_edges[b])]
        assert score == pytest.approx(1 / (1 + math.exp(-total)))
    loss = lambda m: -np.mean(y * np.log(m) + (1 - y) * np.log(1 - m))
    assert loss(np.clip(got, 1e-9, 1 - 1e-9)) < 0.5 * loss(np.full(400, y.mean()))


def plain_terms(text):
    words = re.findall(rb"[0-9a-z\x80-\xff]+", bytes(b + 32 if 65 <= b <= 90 else b for b in text))
    return Counter([w for w in words] + [(w[:n], n) for w in words for n in toxicity.BEGINNINGS if len(w) > n]), len(words)


def test_term_counts_equal_plain_ones(monkeypatch):
    texts = [*TEXTS, "Straßenbahn straßenbahn strass", "the theatre theatrical theatres"]
    for size in (200_000, 7):
        monkeypatch.setattr(toxicity, "SLICE", size)
        text, _, times, words = toxicity.term_counts(*block(texts))
        for i, t in enumerate(texts):
            counts, n = plain_terms(t.encode())
            assert sorted(times[text == i].tolist()) == sorted(counts.values()) and words[i] == n


def test_toxicity_weights_are_the_minimum_of_the_penalised_loss():
    rng = np.random.default_rng(5)
    n, v = 120, 6
    rows, entries = np.nonzero(rng.random((n, v)) < 0.4)
    y = ((np.bincount(rows[entries == 0], minlength=n) > 0) ^ (rng.random(n) < 0.15)).astype(float)
    moved, moved_entries = np.nonzero(rng.random((n, v)) < 0.1)
    by = rng.choice([-1.0, 1.0], len(moved))
    weights, bias = toxicity.fit(v, y, rows, entries, moved, moved_entries, by)

    def loss(w):
        total = 0.0
        for i in range(n):
            m = w[v] + sum(w[e] for e in entries[rows == i])
            total += (math.log1p(math.exp(-abs(m))) + max(m, 0) - y[i] * m) / n
            change = sum(w[e] * b for e, b in zip(moved_entries[moved == i], by[moved == i]))
            total += toxicity.SWAP_WEIGHT / len(set(moved)) * change**2
        return total + 0.5 * toxicity.RIDGE * sum(x * x for x in w[:v])

    at = np.append(weights, bias)
    for k in range(v + 1):
        step = np.zeros(v + 1)
        step[k] = 1e-4
        assert abs(loss(at + step) - loss(at - step)) / 2e-4 < 1e-3


def test_toxicity_scores_equal_plain_sums():
    texts = [*TEXTS, "go go go gone go", "wow " * 9 + "the"]
    words = [b"go", b"gone", b"wow", b"the"]
    hashes = [toxicity.term_counts(*block([w.decode()]))[1] for w in words]
    by_hash = {int(h[0]) if len(h) == 1 else None: w for h, w in zip(hashes, words)}
    vocabulary = np.sort(np.array(list(by_hash), np.uint64))
    weights = np.random.default_rng(2).normal(size=len(vocabulary) * LEVELS)
    got = ToxicityModel(vocabulary, weights, -0.3).score(*block(texts))
    for t, score in zip(texts, got):
        counts, n = plain_terms(t.encode())
        total = -0.3
        for k, h in enumerate(vocabulary.tolist()):
            times = counts[by_hash[h]]
            reached = 0 if not times else 1 + (times >= 2 and times * 400 >= n) + (times >= 2 and times * 100 >= n)
            total += weights[k * LEVELS : k * LEVELS + reached].sum()
        assert score == pytest.approx(1 / (1 + math.exp(-total)))


def test_swaps_of_long_texts_equal_those_of_whole_ones():
    text = ("The Muslim man and the WOMAN, old friends. " * 40).encode()
    assert {swap_identities(text, size) for size in (1, 10, 100, 1 << 20)} == {swap_identities(text)}


def test_very_long_texts_are_scored(spark):
    long = "Wort it's 12 Größe, and the\n" * 1_000_000
    docs = spark.createDataFrame([(1, long), (2, "short"), (3, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (3, 0, 0)], "doc_id bigint, quality int, toxic int")
    for module in (quality, toxicity):
        model = module.train(docs, labels, mod=97, held_out=96)
        assert [r["doc_id"] for r in module.score(docs, model).orderBy("doc_id").collect()] == [1, 2, 3]
