"""Classifiers, search, sharding, chat and the pipeline: brute force, held-out accuracy and edge cases."""

import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import chat, quality, queries, sharding, topk, toxicity
from tessera.llm.store import materialise

SF = "/root/testdata/sf0.001"


def brute_top(rows, is_query, k):
    whole = {}
    width = max((len(v) for _, v in rows if v is not None), default=0)
    rows = [(i, [int(np.floor(256.0 * x)) for x in v] + [0] * (width - len(v))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for i, v in rows:
        if is_query(i):
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in rows if j != i)
            whole[i, tuple(v)] = [(r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted((i, *x) for (i, _), top in whole.items() for x in top)


def test_top_k(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(400)]
    rows += [(900 + i, rows[7][1]) for i in range(60)]  # a hot vector, ties
    rows += [(50, rows[50][1]), (2000, None), (2050, [1.0, None] + [0.0] * 6), (2100, [float("nan")] * 8), (2150, [float("inf")] * 8), (None, [1.0] * 8), (-50, [0.0] * 8), (2200, []), (2201, [1.0, 2.0])]
    vectors = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<float>, score int")
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want = brute_top(rows, lambda i: i % 50 == 0, 5)
    for block in (8192, 16):
        monkeypatch.setattr(topk, "BLOCK_ROWS", block)
        monkeypatch.setattr(topk, "QUERY_ROWS", block // 4)
        got = topk.top_k(vectors, F.col("vec_id") % 50 == 0, 5).collect()
        assert sorted(map(tuple, got)) == want
    assert topk.top_k(vectors.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_bounds_leave_candidates_out():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.integers(-20, 20, (300, 8)) + c for c in (0, 900, -900)])
    ids = np.arange(len(x))
    pivots = topk.far_apart(x, 24)
    calls = []
    original = topk.scorer
    topk.scorer = lambda a, b: lambda rows, i, f=original(a, b): calls.append(len(rows)) or f(rows, i)
    try:
        list(topk.search_block(ids, x, topk.distances(x, pivots), ids[:1], x[:1], topk.distances(x[:1], pivots), np.array([np.iinfo(np.int64).min]), 5))
    finally:
        topk.scorer = original
    assert sum(calls) <= 300 < len(x)


@pytest.mark.parametrize("norm", [5e6, 1e7, 1e12])
def test_bounds_hold_beside_an_outlier(norm):
    rng = np.random.default_rng(int(norm) % 97)
    centres = rng.normal(size=(20, 64))
    x = np.repeat(centres, 100, axis=0) + 0.1 * rng.normal(size=(2000, 64))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)
    far = rng.normal(size=64)
    x = np.concatenate([x, [np.floor(norm * far / np.linalg.norm(far)).astype(np.int64)]])
    ids, q = np.arange(len(x)), slice(0, 1200)
    pivots = topk.far_apart([*x[::7], x[-1]], 24)
    got = {i: (a.tolist(), s.tolist()) for i, a, s in topk.search_block(ids, x, topk.distances(x, pivots), ids[q], x[q], topk.distances(x[q], pivots), np.full(1200, np.iinfo(np.int64).min), 5)}
    scores = x[q].astype(object) @ x.T.astype(object)
    for i in range(1200):
        best = sorted((-int(s), j) for j, s in enumerate(scores[i]) if j != i)[:5]
        assert got[i] == ([j for _, j in best], [-s for s, _ in best])


def test_widths_meet(spark):
    rows = [(i, [float(i % 7 - 3)] * (i % 5)) for i in range(60)] + [(100, [1.0] * 9_000), (150, [2.0] * 20_000)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = topk.top_k(vectors, F.col("vec_id") % 50 == 0, 5).collect()
    assert sorted(map(tuple, got)) == brute_top(rows, lambda i: i % 50 == 0, 5)


def test_scores_beyond_64_bits_raise(spark):
    vectors = spark.createDataFrame([(0, [1e16]), (1, [1e16])], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="beyond 64-bit"):
        topk.top_k(vectors, F.col("vec_id") == 0).collect()


def test_shards(spark, odd_docs, odd_rows, no_docs):
    got = sharding.shard_documents(odd_docs, 4).collect()
    assert len(got) == len(odd_rows)
    want = sorted((str(i), 16 + len((t or "").encode()), zlib.crc32((t or "").encode())) for i, t in odd_rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    counts = [sorted(r["slot"] for r in got if r["shard"] == s) for s in range(4)]
    assert all(c == list(range(len(c))) for c in counts) and max(map(len, counts)) - min(map(len, counts)) <= 1
    again = sharding.shard_documents(odd_docs.repartition(7), 4).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert sharding.shard_documents(no_docs, 4).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 1009])
def test_permutation_is_a_bijection(spark, n):
    places = [r["p"] for r in spark.range(n).select(sharding.permuted(F.col("id"), n, 3).alias("p")).collect()]
    assert sorted(places) == list(range(n))


def test_native_operators_have_no_python(spark):
    for name in ("op4_chat_formatting", "op5_sharding"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_written_shards(spark, odd_docs, odd_rows, tmp_path):
    sharding.write_shards(odd_docs.drop("shard"), str(tmp_path / "s"), 3)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == len(odd_rows) and back.select("shard").distinct().count() == 3


def J(x):
    return json.dumps(x)


CHAT = [
    (1, 0, "user", 'hi "x"\n'),
    (1, 1, "assistant", J({"content": None, "tool_calls": [{"name": "search", "id": "a", "arguments": {"query": "q", "limit": "3", "zz": 1}}]})),
    (1, 2, "tool", J({"tool_call_id": "a", "content": {"b": 1, "a": [1, 2]}})),
    (1, 3, "assistant", J({"content": "then", "tool_calls": [{"id": "c", "name": "read_file", "arguments": J({"path": "$a"})}]})),
    (1, 4, "tool", J({"tool_call_id": "nope", "content": "?"})),
    (2, 0, "tool", J({"tool_call_id": "x", "content": "early"})),
    (2, 1, "assistant", J({"tool_calls": [{"id": "x", "name": "run", "arguments": {"command": "ls", "timeout": 1.5, "env": {}}}]})),
    (3, 0, "assistant", J({"tool_calls": [{"id": "p", "name": "search", "arguments": {"query": "$q"}}]})),
    (3, 1, "assistant", J({"tool_calls": [{"id": "q", "name": "search", "arguments": {"query": "$p"}}]})),
    (4, 0, None, None),
    (None, 1, "user", ""),
    (5, 0, "assistant", "{bad json"),
    (5, 1, "assistant", J({"tool_calls": [{"id": "d", "name": "nix", "arguments": "no"}]})),
    (5, 2, "assistant", J({"tool_calls": [{"id": "d", "name": "search", "arguments": {}}]})),
    (6, 0, "user", "same"),
    (6, 0, "user", "same"),
]
LINKS = {(1, 1): "linked", (1, 2): "linked", (1, 3): "no_result", (1, 4): "orphan", (2, 0): "linked", (2, 1): "linked", (3, 0): "cyclic", (3, 1): "cyclic", (5, 1): "no_result", (5, 2): "duplicate"}
ERRORS = {(1, 1): "a: type of limit; a: unknown zz", (5, 1): "d: unknown tool", (5, 2): "d: missing query"}


def test_chat(spark):
    table = spark.createDataFrame([(*r, "x", 1) for r in CHAT], "conv_id bigint, turn bigint, role string, text string, line string, level int")
    got = chat.format_chat(table, queries.TOOLS).collect()
    assert len(got) == len(CHAT)
    for r in got:
        key = (r["conv_id"], r["turn"])
        assert r["link"] == LINKS.get(key), key
        assert (r["tool_errors"] or None) == ERRORS.get(key), key
        message = json.loads(r["message"])
        assert r["message"] == json.dumps(message, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        text = next(t for c, n, _, t in CHAT if (c, n) == key)
        if r["link"] is None:
            assert message == {"content": text, "role": r["role"]}
        else:
            assert message["content"] == json.loads(text).get("content")
    place = {(r["conv_id"], r["turn"]): (r["order_turn"], r["order_level"], r["turn"]) for r in got}
    assert place[2, 1] < place[2, 0] and place[1, 1] < place[1, 2] < place[1, 3]
    assert chat.format_chat(table.limit(0), queries.TOOLS).count() == 0


def brute_chat(rows):
    """(link, place) of every call and result by plain Python: places by repeated passes over each conversation."""
    out = {}
    for conv in {r[0] for r in rows}:
        said = [(n, json.loads(t)) for c, n, _, t in rows if c == conv and t.startswith("{")]
        calls, answered, uses = {}, {}, {}
        for n, m in sorted(said, key=lambda x: x[0]):
            for c in m.get("tool_calls", []):
                calls.setdefault(c["id"], n)
                uses.setdefault(n, set()).update(v[1:] for v in c["arguments"].values() if str(v).startswith("$"))
            if "tool_call_id" in m:
                answered.setdefault(m["tool_call_id"], n)
        place = {}
        while True:
            new = {}
            for n, ids in uses.items():
                needs = [(calls[i], answered.get(i, calls[i])) for i in ids if i in calls]
                if n not in place and all(c in place for c, _ in needs):
                    after = [(place[c][0], place[c][1] + 2) if place[c][0] >= a else (a, 1) for c, a in needs]
                    new[n] = max([(n, 0), *after])
            if not new:
                break
            place.update(new)
        natural = all(max(calls[i], answered.get(i, calls[i])) < n for n, ids in uses.items() for i in ids if i in calls)
        for n, m in said:
            if "tool_calls" in m:
                ids = [c["id"] for c in m["tool_calls"]]
                link = "cyclic" if n not in place else "duplicate" if len(set(ids)) < len(ids) or any(calls[i] < n for i in ids) else "no_result" if any(i not in answered for i in ids) else "linked"
                out[conv, n] = (link, place.get(n, (n, 0)))
            else:
                call = calls.get(m["tool_call_id"])
                at, level = place.get(call, (call, 0)) if call is not None else (-1, 0)
                link = "orphan" if call is None else "linked" if call in place else "cyclic"
                out[conv, n] = (link, (at, level + 1) if at >= n else (n, 0))
        assert not natural or all(p == (n, 0) for n, p in place.items())
    return out


def test_chat_against_brute_force(spark):
    rnd = random.Random(11)
    rows = []
    for conv in range(120):
        names = [f"c{k}" for k in range(rnd.randrange(1, 9))]
        said = []
        for k, name in enumerate(names):
            use = [f"${x}" for x in rnd.sample(names if conv % 3 == 0 else names[:k], min(k, rnd.randrange(3)) if conv % 3 else rnd.randrange(min(3, len(names) + 1)))]
            call = {"id": rnd.choice(names) if conv % 5 == 4 else name, "name": "search", "arguments": {"query": "q", **{f"u{j}": u for j, u in enumerate(use)}}}
            said.append(("assistant", {"content": None, "tool_calls": [call]}))
            if rnd.random() < 0.3 and len(said) > 1 and "tool_calls" in said[-2][1]:
                said[-2][1]["tool_calls"] += said.pop()[1]["tool_calls"]
            if rnd.random() < 0.8:
                said.append(("tool", {"tool_call_id": rnd.choice([name, "nobody"]) if conv % 7 == 6 else name, "content": {"z": [1, None], "ä": "x"}}))
        if conv % 2:
            rnd.shuffle(said)
        rows += [(conv, n, role, J(m)) for n, (role, m) in enumerate(said)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(4)
    got = {(r["conv_id"], r["turn"]): r for r in chat.format_chat(table, queries.TOOLS).collect()}
    assert "ShuffledHashJoin" in chat.format_chat(table, queries.TOOLS)._jdf.queryExecution().executedPlan().toString()
    want = brute_chat(rows)
    assert len(got) == len(rows) == len(want)
    assert {k: (r["link"], (r["order_turn"], r["order_level"])) for k, r in got.items()} == want
    assert {link for link, _ in want.values()} == {"linked", "cyclic", "duplicate", "no_result", "orphan"}
    texts = {(c, n): json.loads(t) | {"role": role} for c, n, role, t in rows}
    for k, r in got.items():
        assert r["message"] == json.dumps(texts[k], sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_chat_long_chain_needs_no_rounds(spark):
    rows = [(1, n, "assistant", J({"content": "x", "tool_calls": [{"id": f"c{n}", "name": "search", "arguments": {"query": f"$c{n - 2}"}}]})) if n % 2 == 0 else (1, n, "tool", J({"tool_call_id": f"c{n - 1}", "content": n})) for n in range(600)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    assert all((r["order_turn"], r["order_level"], r["link"]) == (r["turn"], 0, "linked") for r in chat.format_chat(table, queries.TOOLS).collect())


def test_chat_keys_stand_in_order(spark):
    table = spark.createDataFrame([CHAT[1], CHAT[2]], "conv_id bigint, turn bigint, role string, text string")
    for r in chat.format_chat(table, queries.TOOLS).collect():
        pairs = json.loads(r["message"], object_pairs_hook=list)
        names = [k for k, _ in pairs]
        assert names == sorted(names)


def test_quality_and_toxicity_on_held_out_rows(spark):
    labels = {r["doc_id"]: r for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    for name, label, mod, out in (("op3_quality_classifier", "quality", 3, 1), ("op10_toxicity", "toxic", 5, 0)):
        got = queries.QUERIES[name](spark, "/root/testdata/sf0.01").collect()
        assert len(got) == 1000
        for r in got:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % mod == out) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
        held = [r for r in got if r["held_out"] and r["doc_id"] in labels]
        assert np.mean([r["predicted"] == labels[r["doc_id"]][label] for r in held]) >= 0.93, name


def test_classifiers_on_odd_rows(spark, odd_docs, odd_rows, no_docs):
    labels = spark.createDataFrame([(i * 3, i % 2, i % 3 % 2, "x") for i in range(20)] + [(None, 1, 1, "x"), (3, None, None, "x")], "doc_id bigint, quality int, toxic int, text string")
    for module in (quality, toxicity):
        for table in (labels, labels.limit(0)):
            model = module.train(odd_docs, table)
            scores = module.score(odd_docs.select("doc_id", "text", "lang"), model).collect()
            assert len(scores) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in scores)
        assert module.score(no_docs.select("doc_id", "text"), model).count() == 0


def test_pair_tables_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert np.mean((model.score(x) >= 0.5) == y) > 0.95


def test_swaps_lower_the_weight_of_identity_terms():
    # entry 0: an insult; entries 1, 2: two identity terms, of which one goes with toxic texts in this sample
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 400).astype(float)
    insult = (y == 1) & (rng.random(400) < 0.7)
    term = np.where(y == 1, rng.random(400) < 0.6, rng.random(400) < 0.1)
    rows = np.concatenate([np.flatnonzero(insult), np.flatnonzero(term)])
    entries = np.concatenate([np.zeros(insult.sum(), int), np.ones(term.sum(), int)])
    named = np.flatnonzero(term)
    free, _ = toxicity.fit(3, y, rows, entries, np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    moved = np.concatenate([named, named])
    swap_entries = np.concatenate([np.ones(len(named), int), np.full(len(named), 2)])
    fair, _ = toxicity.fit(3, y, rows, entries, moved, swap_entries, np.concatenate([-np.ones(len(named)), np.ones(len(named))]))
    assert abs(fair[1] - fair[2]) < 0.3 * abs(free[1] - free[2]) and fair[0] > 1


def test_identity_terms_are_swapped():
    assert toxicity.swap_identities(b"A Muslim man, women!") == b"a jewish woman, men!"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF))
        if name != "packing":
            assert docs.columns == columns and docs.count() <= seen
            seen = docs.count()
    assert docs.select("doc_id").distinct().count() == seen
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "suffix_dedup", "decontamination", "packing"]
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_stages_take_odd_rows(spark, odd_docs, no_docs):
    plain = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            out.count()
            assert name == "packing" or out.columns == docs.columns
    assert set(plain) <= set(odd_docs.columns)
