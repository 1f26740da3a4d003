"""Registered queries over whole tables, against brute force: rows, ids and texts past any fixed range."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessera.operators import search
from tessera.plans import registry

SF = "/root/testdata/sf0.001"


def read(name, folder=SF):
    return pq.read_table(f"{folder}/{name}.parquet").to_pylist()


def run(spark, name, folder=SF):
    return registry.QUERIES[name](spark, str(folder)).collect()


def test_pagerank_of_all_edges(spark):
    weight = Counter((r["l_orderkey"], r["l_partkey"]) for r in read("lineitem"))
    out = Counter()
    for (a, _), w in weight.items():
        out[a] += w
    nodes = {x for e in weight for x in e}
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(5):
        loose, got = sum(r for n, r in rank.items() if n not in out), defaultdict(float)
        for (a, b), w in weight.items():
            got[b] += rank[a] * w / out[a]
        rank = {n: 0.15 / len(nodes) + 0.85 * (got[n] + loose / len(nodes)) for n in nodes}
    rows = run(spark, "pagerank")
    assert len(rows) == len(nodes) > 500
    assert {r["node"]: r["rank"] for r in rows} == pytest.approx(rank, rel=1e-9)


def test_embedding_context_of_every_text(spark):
    want = {d["doc_id"]: f"File: {d['source']}/{d['lang']}/{d['doc_id']}.txt\nPackage: {d['lang']}\n\n{d['text']}" for d in read("documents")}
    assert {r["id"]: r["context"] for r in run(spark, "embedding_context")} == want


@pytest.mark.parametrize("block, values", [(1_000, 1 << 24), (2, 1_000)])
def test_searches_of_every_hundredth_row(spark, monkeypatch, block, values):
    monkeypatch.setattr(search, "QUERY_BLOCK", block)
    monkeypatch.setattr(search, "BLOCK_VALUES", values)
    monkeypatch.setattr(search, "SCORES", values)
    rows = {r["vec_id"]: (r["label"], np.array(r["embedding"], float)) for r in read("embeddings")}
    queries = [i for i in rows if i % 100 == 0]
    assert len(queries) > 2 and max(queries) > 25
    best, quality = set(), {}
    for q in queries:
        score = {i: float(x @ rows[q][1] / np.linalg.norm(x) / np.linalg.norm(rows[q][1])) for i, (_, x) in rows.items()}
        best |= {(q, k + 1, i) for k, i in enumerate(sorted(rows, key=lambda i: (-round(score[i], 6), i))[:5])}
        hits = [rows[i][0] == rows[q][0] for i in sorted(rows, key=lambda i: (-round(score[i], 9), i)) if i != q][:50]
        wanted = sum(label == rows[q][0] for label, _ in rows.values()) - 1
        at = [k + 1 for k, hit in enumerate(hits) if hit]
        ideal = sum(1 / math.log2(k + 2) for k in range(min(wanted, 10)))
        quality[q] = (sum(hits[:5]) / 5, sum(hits[:20]) / wanted, sum(1 / math.log2(k + 1) for k in at if k <= 10) / ideal, sum(at) / len(at) if at else None)
    assert {(r["query_id"], r["rank"], r["chunk_id"]) for r in run(spark, "batch_topk")} == best
    got = {r["query_id"]: (r["precision_5"], r["recall_20"], r["ndcg_10"], r["acr"]) for r in run(spark, "retrieval_metrics")}
    assert set(got) == set(quality)
    for q in quality:
        assert got[q] == pytest.approx(quality[q], abs=1e-6)


def test_messages_past_any_range(spark, tmp_path):
    rows = [(conv, turn, ("user", "assistant", "system")[(conv + turn) % 3], f"t{conv}-{turn}") for conv in (3, 19, 20, 39, 40, 41, 5_000) for turn in range(4)]
    pq.write_table(pa.table(dict(zip(("conv_id", "turn", "role", "text"), map(list, zip(*rows))))), tmp_path / "conversations.parquet")
    assert {r["file_id"]: r["body"] for r in run(spark, "prompt_body", tmp_path)} == {c: "\n".join(f"t{c}-{t}" for t in range(4)) for c, *_ in rows}
    calls = [(c * 1000 + t, role, "assistant" if t % 2 == 0 else "user") for c, t, role, _ in rows]
    want = {(a, b, "call", name) for a, _, called in calls for b, name, _ in calls if name == called and a != b}
    got = [(r["from_id"], r["to_id"], r["dep_type"], r["symbol"]) for r in run(spark, "derive_edges", tmp_path)]
    assert len(got) == len(want) and set(got) == want


def test_fusion_over_all_rows(spark):
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in read("embeddings")}
    cosine = {i: round(float(x @ rows[0] / np.linalg.norm(x) / np.linalg.norm(rows[0])), 6) for i, x in rows.items()}
    size = {d["doc_id"]: d["n_chars"] for d in read("documents")}
    scaled = [{i: (x - min(m.values())) / (max(m.values()) - min(m.values())) for i, x in m.items()} for m in (cosine, size)]
    want = {i: 0.7 * scaled[0].get(i, 0) + 0.3 * scaled[1].get(i, 0) for i in cosine.keys() | size.keys()}
    assert {r["id"]: r["hybrid"] for r in run(spark, "fusion_minmax")} == pytest.approx(want, abs=2e-6)


def test_rewrites_over_all_rows(spark):
    assert {r["id"]: r["score"] for r in run(spark, "query_rewrite_merge")} == {d["doc_id"]: max(d["doc_id"] % 7, d["doc_id"] % 5) for d in read("documents")}


def test_insert_of_all_rows(spark):
    rows = [(r["l_orderkey"], r["l_partkey"], r["l_returnflag"], r["l_linestatus"] if r["l_linenumber"] != 1 else None) for r in read("lineitem")]
    whole, loose = {r for r in rows if r[3] is not None}, Counter(r for r in rows if r[3] is None)
    assert Counter(map(tuple, run(spark, "dep_insert_ignore"))) == Counter(whole) + loose + loose


def test_prompt_holds_whole_hits(spark):
    rows, text = {r["vec_id"]: np.array(r["embedding"], float) for r in read("embeddings")}, {d["doc_id"]: d for d in read("documents")}
    score = {i: round(float(x @ rows[0] / np.linalg.norm(x) / np.linalg.norm(rows[0])), 6) for i, x in rows.items()}
    hits = [i for i in sorted(rows, key=lambda i: (-score[i], i))[:5] if i in text]
    parts = [f"### {k + 1}. {text[i]['source']}/{text[i]['lang']}/{i}.txt (score {score[i]:.3f})\n{text[i]['text']}" for k, i in enumerate(hits)]
    assert any(len(text[i]["text"]) > 60 for i in hits)
    assert [r["context"] for r in run(spark, "prompt_context")] == ["\n\n".join(parts)]


def test_architecture_summary_is_whole(spark):
    want = {d["doc_id"]: d["text"] for d in read("documents") if d["source"] == "src2" and d["lang"] == "en" and d["doc_id"] % 12 == 2}
    assert {r["id"]: r["content"] for r in run(spark, "architecture_summary")} == want


def test_summaries_are_whole(spark):
    from tessera.sources.views import Views

    assert {r["id"]: r["content"] for r in Views(spark, SF).summaries.collect()} == {d["doc_id"]: d["text"] for d in read("documents")}


def test_queries_stay_off_the_driver(spark):
    """One scan of the vectors as rows and one as queries, whatever their number."""
    plan = registry.QUERIES["batch_topk"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 2 and plan.count("MapInArrow") == 1
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_searches_of_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_VALUES", 8)
    rows = [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [None, 1.0])]
    e = spark.createDataFrame(rows, "chunk_id bigint, vector array<float>").repartition(3)
    q = spark.createDataFrame([("a", [3.0, 0.0]), ("b", [1.0, 2.0, 3.0]), ("c", None), ("d", [0.0, 0.0]), (None, [0.0, 1.0])], "query_id string, query_vector array<double>")
    got = {(r["query_id"], r["rank"]): (r["chunk_id"], r["score"]) for r in search.batch_top_k(e, q, 2).collect()}
    assert got == {("a", 1): (1, 1.0), ("a", 2): (8, 1.0), ("b", 1): (7, 1.0), (None, 1): (2, 1.0), (None, 2): (3, 0.707107)}
    assert search.batch_top_k(e.limit(0), q, 2).count() == 0 == search.batch_top_k(e, q.limit(0), 2).count()
    docs = e.selectExpr("chunk_id % 2 as doc", "chunk_id as token", "vector")
    sims = {r["doc"]: r["max_sim"] for r in search.max_sim(q.select("query_vector"), docs).collect()}
    assert sims == {0: 2.0 + 0.0 + 6.0, 1: 3.0 + 3.0 + 14.0, None: 3.0}
