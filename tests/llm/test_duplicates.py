"""Jaccard join, suffix dedup and decontamination against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from tessera.llm import components, decontam, jaccard, suffixes


def shingles(text, k):
    for c in "\t\n\x0b\x0c\r":
        text = (text or "").replace(c, " ")
    w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in text.split(" ") if x]
    return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


def brute_components(rows, k, num):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= num * len(a | b):
                parent[root(i)] = root(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[root(i)] = min(d, ids.get(root(i), d))
    return sorted(((d, len(sets[i]), ids.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("k,num", [(3, 90), (5, 80), (2, 50)])
def test_components_of_odd_rows(odd_docs, odd_rows, k, num):
    got = jaccard.jaccard_components(odd_docs, k, num, 100).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute_components(odd_rows, k, num)


def test_components_of_near_copies(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    bases = [[rnd.choice(words) for _ in range(rnd.choice([20, 40, 80]))] for _ in range(8)]
    rows = []
    for i in range(160):
        text = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 1, 1, 2, 3, 5])):
            text[rnd.randrange(len(text))] = rnd.choice(words)
        rows.append((i * 7, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for k, num in ((3, 90), (3, 70)):
        got = jaccard.jaccard_components(docs, k, num, 100).collect()
        assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute_components(rows, k, num)


def test_one_of_each_group_stays(odd_docs, odd_rows):
    got = [(r["doc_id"], r["text"]) for r in jaccard.keep_one(odd_docs, 5, 80, 100).collect()]
    assert len(got) == len(set(got))
    comp = brute_components(odd_rows, 5, 80)
    worded = {c for d, n, c in comp if n and c is not None}
    assert {d for d, t in got if d is not None and shingles(t, 5)} == worded


def test_star_components_equal_united(spark):
    rnd = random.Random(1)
    links = spark.createDataFrame([(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(900 + i, 901 + i) for i in range(40)], "u bigint, v bigint")
    want = sorted(map(tuple, components.components(links.filter("u <> v")).collect()))
    assert sorted(set(map(tuple, components.star_components(links).collect()))) == want


def test_no_documents(no_docs):
    assert jaccard.jaccard_components(no_docs).count() == 0
    assert jaccard.keep_one(no_docs).count() == 0
    assert suffixes.digest(suffixes.repeats(no_docs)).count() == 0
    assert suffixes.remove_repeats(no_docs).columns == no_docs.columns


def brute_repeats(rows):
    seen, out = set(), {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (t or "").encode()
        covered = np.zeros(len(raw), bool)
        for s in range(len(raw) - 99):
            if raw[s : s + 100] in seen:
                covered[s : s + 100] = True
            seen.add(raw[s : s + 100])
        edge = np.diff(np.concatenate([[0], covered.astype(int)]))
        out[i, t] = (len(raw), int(covered.sum()), int((edge == 1).sum()), hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~covered])).hexdigest())
    return out


@pytest.mark.parametrize("most", [suffixes.MOST, 3, 0])
def test_repeats_of_distinct_ids(spark, odd_rows, monkeypatch, most):
    monkeypatch.setattr(suffixes, "MOST", most)
    line = "A line of forty bytes that all repeat, \n"
    rnd = random.Random(6)
    rows = [(n, t) for n, (_, t) in enumerate(odd_rows)] + [(1_000 + n, "".join(rnd.choice("xyz ") for _ in range(90)) + line + str(rnd.random()) * 5) for n in range(30)]
    got = suffixes.digest(suffixes.repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))).collect()
    want = brute_repeats(rows)
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"], texts[r["doc_id"]]], r["doc_id"]


def test_repeats_with_repeated_and_null_ids(odd_docs, odd_rows):
    got = suffixes.digest(suffixes.repeats(odd_docs)).collect()
    assert len(got) == len(odd_rows)
    want = brute_repeats(odd_rows)
    once = [i for i, _ in odd_rows if i is not None and sum(i == j for j, _ in odd_rows) == 1]
    by_id = {r["doc_id"]: r for r in got}
    texts = dict(odd_rows)
    for i in once:
        if texts[i] not in [t for j, t in odd_rows if j == 6 or j is None]:
            r = by_id[i]
            assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == want[i, texts[i]][:3], i


def test_removed_texts_are_whole(odd_docs):
    out = suffixes.remove_repeats(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    for r in out.collect():
        assert "�" not in (r["text"] or "")


def test_suffix_order_is_the_sorted_order():
    rnd = random.Random(2)
    texts = [bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(1, 60))) for _ in range(300)]
    group = np.sort(np.array([rnd.randrange(5) for _ in texts]))
    size = np.array([len(t) for t in texts])
    start = np.cumsum(size) - size
    data = np.frombuffer(b"".join(texts), np.uint8)
    order = suffixes.suffix_order(data, suffixes.prefix_hashes(data), start, size, group)
    assert [(group[i], texts[i]) for i in order] == sorted(zip(group.tolist(), texts))


def test_anchors_own_every_window():
    rnd = random.Random(4)
    data = np.frombuffer(bytes(rnd.choice(b"abc ") for _ in range(3000)), np.uint8)
    offsets = np.array([0, 50, 1200, 1299, 3000])
    text, p, low, high, _, _ = suffixes.anchors(data, offsets)
    owned = sorted(int(x) - o for x, a, b in zip(p, low, high) for o in range(a, b + 1))
    want = [s for a, b in zip(offsets[:-1], offsets[1:]) for s in range(a, b - 99)]
    assert owned == want


def substituted(rnd, words, n):
    out = list(words)
    for i in rnd.sample(range(len(out)), n):
        out[i] = f"zz{rnd.randrange(1000)}"
    return out


def test_masks_stand_any_three_substitutions():
    from itertools import combinations

    for gone in combinations(range(12), 3):
        assert any(not ({o + x for x in m} & set(gone)) for m in decontam.MASKS for o in range(12 - m[-1]))


def test_contaminated_documents(spark):
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([5, 9, 14, 40])))) for i in range(30)] + [(30, None), (31, "")]
    docs, want = [], set()
    for d in range(120):
        text = [rnd.choice(words) for _ in range(rnd.choice([0, 30, 200]))]
        if d % 3 == 0:
            item = items[rnd.randrange(30)]
            w = item[1].split()
            many = 3 if len(w) >= 12 else 2 if len(w) >= 8 else 0
            at = rnd.randrange(len(text) + 1)
            text[at:at] = substituted(rnd, w[:12] if len(w) >= 12 else w, many)
            want.add((d, item[0]))
        docs.append((d, " ".join(text).upper() + "!"))
    docs += [(500, None), (501, "")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(frame, bench).collect()}
    assert got == want
    kept = {r["doc_id"] for r in decontam.decontaminate(frame, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}


def test_items_may_be_as_many_as_documents(odd_docs, odd_rows, spark):
    items = spark.createDataFrame([(i, t) for i, t in odd_rows if t and len(t) < 5000], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(odd_docs, items).collect()}
    assert {(i, i) for i, t in odd_rows if i is not None and t and re.search(r"\w", t) and len(t) < 5000} <= got
    assert decontam.decontaminate(odd_docs, items.limit(0)).count() == len(odd_rows)


def test_equal_hashes_of_different_bytes_raise_in_a_task():
    data = np.frombuffer(b"a" * 100 + b"b" * 100, np.uint8)
    held = np.zeros(2, suffixes.ANCHOR)
    held["a"], held["c"], held["id"] = 7, 9, [1, 2]  # a forged collision: one gram, one context, different bytes
    with pytest.raises(ArithmeticError, match="one hash"):
        list(suffixes._dealt(held, np.array([0, 100]), np.array([0, 1]), data, 8))
    same = np.frombuffer(b"a" * 200, np.uint8)
    rows = [b.to_pydict() for b in suffixes._dealt(held, np.array([0, 100]), np.array([0, 1]), same, 8)]
    assert [r["bucket"] for r in rows][0] == [-1] and np.frombuffer(rows[0]["a"][0], "<u8").tolist() == [100]


def test_equal_hashes_of_different_bytes_raise_between_tasks(spark, monkeypatch):
    for text, right in (("b" * 100, False), ("a" * 100, True)):
        docs = spark.createDataFrame([(1, "a" * 100), (2, text)], "doc_id bigint, text string")
        found = spark.createDataFrame([(suffixes._REPEAT, 2, 0, 0, 0, 0, 7, 1, 0, 0)], suffixes._FOUND)  # as if (2, 0) had the hash of (1, 0)
        none = spark.createDataFrame([], "id bigint, h bigint, start int, end int")
        monkeypatch.setattr(suffixes, "_spans", lambda *_, found=found, none=none: (found, none))
        if right:
            assert {r["doc_id"]: r["n_removed"] for r in suffixes.digest(suffixes.repeats(docs)).collect()} == {1: 0, 2: 100}
        else:
            with pytest.raises(Exception, match="one hash"):
                suffixes.repeats(docs).collect()


def test_long_texts_by_stretches(spark, monkeypatch):
    rnd = random.Random(8)
    base = "".join(rnd.choice("abcdefgh ") for _ in range(3_000))
    rows = [(0, base), (1, base[500:2_000] + base[100:900]), (2, "x" * 400 + base[1_000:1_500]), (3, "y" * 99), (4, base[-700:] + base[:700])]
    whole = sorted(map(tuple, suffixes.digest(suffixes.repeats(spark.createDataFrame(rows, "doc_id bigint, text string"))).collect()))
    want = brute_repeats(rows)
    assert {r[0]: r[1:] for r in whole} == {i: want[i, t] for i, t in rows}
    data = np.frombuffer(base.encode(), np.uint8)
    monkeypatch.setattr(suffixes, "STRETCH", 150)
    owned = [s for a, part, cuts in suffixes.stretches(data, np.array([0, len(data)])) for t, p, lo, hi, _, _ in [suffixes.anchors(part, cuts)] for x, b, e in zip(p, lo, hi) for s in range(a + x - e, a + x - b + 1)]
    assert sorted(owned) == list(range(len(data) - 99))


def test_a_very_long_text_repeats(spark):
    rnd = random.Random(5)
    part = "".join(rnd.choice("abcdefghij \n") for _ in range(700_000))
    rows = [(1, part + "-" * 50 + part), (2, part[:1_000])]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffixes.digest(suffixes.repeats(spark.createDataFrame(rows, "doc_id bigint, text string"))).collect()}
    assert got == {1: (1_400_050, 700_000, 1), 2: (1_000, 1_000, 1)}


def test_a_very_long_periodic_text(spark):
    rows = [(1, "=" * 3_000_000), (2, "ab " * 700_000), (3, "=" * 150)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffixes.digest(suffixes.repeats(spark.createDataFrame(rows, "doc_id bigint, text string"))).collect()}
    assert got == {1: (3_000_000, 2_999_999, 1), 2: (2_100_000, 2_099_997, 1), 3: (150, 150, 1)}


@pytest.mark.parametrize("most", [suffixes.MOST, 0])
def test_rows_equal_in_id_and_text_are_one_document(spark, monkeypatch, most):
    monkeypatch.setattr(suffixes, "MOST", most)
    rnd = random.Random(4)
    text = "".join(rnd.choice("abcdef ") for _ in range(400))
    rows = [(1, text), (1, text), (1, text), (2, text[:250] + "!"), (2, text[:250] + "!"), (3, None), (3, None), (4, "-" * 120), (4, "-" * 120)]
    want = brute_repeats(rows)
    for parts in (1, 5):
        got = suffixes.digest(suffixes.repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts))).collect()
        assert len(got) == len(rows)
        texts = dict(rows)
        assert all((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"], texts[r["doc_id"]]] for r in got)
