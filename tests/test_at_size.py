"""What registered queries do must not depend on how large their tables are: digits, tasks, copies."""

import datetime
import hashlib
import math
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq

from tessera.operators import ask, graph, indexing, inverted, kpis, lineage, scopes, summaries
from tessera.plans import registry
from tessera.sources import content_model

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_one_name_are_not_shuffled(spark):
    rows = [(i, "ab"[i % 2], ["a", "a", None]) for i in range(40)] * 2 + [(99, None, ["b"]), (99, None, ["c"])]
    got = graph.derive_edges(spark.createDataFrame(rows, "id int, name string, calls array<string>"))
    want = {(i, j, "call", "a") for i in range(40) for j in range(0, 40, 2) if i != j} | {(99, j, "call", "b") for j in range(1, 40, 2)}
    found = [tuple(r) for r in got.select("from_id", "to_id", "dep_type", "symbol").collect()]
    assert len(found) == len(want) and set(found) == want
    above = plan(got).split("Join")[0]
    assert "Aggregate" not in above and "Exchange" not in above


def test_pairs_of_a_name_are_written_by_tiles(spark, tmp_path, monkeypatch):
    # 25,000 ids don't come again within a page, so that in their order each pair takes two bytes and more.
    rows = spark.range(25_400).selectExpr("id", "if(id < 400, null, 'a') AS name", "if(id < 400, array('a'), array()) AS calls")
    got = graph.derive_edges(rows)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as at size
    try:
        got.write.parquet(str(tmp_path / "edges"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert spark.read.parquet(str(tmp_path / "edges")).distinct().count() == 400 * 25_000
    assert sum(f.stat().st_size for f in (tmp_path / "edges").glob("*.parquet")) < 400 * 25_000 / 2
    # Behind the join a fence, as generated code holds all that comes of a row.
    above = plan(got).split("Join")[0]
    assert above.index("Generate") < above.index("Coalesce")
    monkeypatch.setattr(graph, "TILE", 3)
    odd = [(i, "ab"[i % 2], ["a", "b", "a", None, "c"][i % 3 :]) for i in range(50)] * 2 + [(None, "a", ["b"]), (90, None, ["a"]), (91, "c", None)]
    want = {(i, j, "call", n) for i, _, calls in odd for c in set(calls or []) for j, n, _ in odd if n == c and None not in (i, j, n) and i != j}
    for spread in (1, 4, 10):
        found = [tuple(r) for r in graph.derive_edges(spark.createDataFrame(odd, "id int, name string, calls array<string>"), spread).collect()]
        assert len(found) == len(want) and set(found) == want


def test_pagerank_has_the_digits_of_its_sql(spark):
    ranks = [r["rank"] for r in registry.QUERIES["pagerank"](spark, SF).collect()]
    assert ranks == [round(r, 9) for r in ranks]


def test_drift_has_percentiles(spark):
    day = datetime.datetime(2024, 1, 1)
    rows = [(day + datetime.timedelta(days=i % 14), i / 10, i % 3) for i in range(1400) for _ in range(i % 3 + 1)]
    got = {r["week"]: r for r in kpis.distribution(spark.createDataFrame(rows, "ts timestamp_ntz, score double, k int")).collect()}
    for k, week in enumerate(("2024-01-01", "2024-01-08")):
        mine = sorted(s for t, s, _ in rows if (t - day).days // 7 == k)
        for name, q in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9)):
            at = q * (len(mine) - 1)
            low = mine[int(at)]
            assert got[week][name] == round(low + (mine[min(int(at) + 1, len(mine) - 1)] - low) * (at - int(at)), 4)
    assert {"p10", "p50", "p90"} <= set(registry.QUERIES["similarity_drift_weekly"](spark, SF).columns)


def test_files_of_narrow_rows_are_dealt_to_all_cores(spark, tmp_path):
    part = pq.read_table(f"{SF}/part.parquet")
    pq.write_table(pa.concat_tables([part] * 2), tmp_path / "part.parquet")
    for name in ("go_declarations", "go_imports", "go_logic", "go_file_summary", "go_chunks", "unit_lines"):
        rows = registry.QUERIES[name](spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() >= 4, name


def test_cycles_of_a_range_are_one_node(spark, monkeypatch):
    ring = lambda at, n: [(at + i, at + (i + 1) % n) for i in range(n)]
    rows = [e for k in range(20) for e in ring(100 * k, 9)] + [(100 * k + 3, 100 * k + 104) for k in range(19)] + [(50, 60), (7, 50), (60, 104)]
    want = {a for k in range(20) for a, _ in ring(100 * k, 9)}
    monkeypatch.setattr(graph, "ONE_TASK", 0)
    monkeypatch.setattr(graph, "RANGE", 50)
    # Without the ranges every ring takes rounds of its own, as the greatest node reaches the last one alone.
    rounds = []
    whole = graph._greatest_components
    monkeypatch.setattr(graph, "_greatest_components", lambda edges: rounds.append(1) or whole(edges))
    assert {r["node"] for r in graph.cycle_nodes(spark.createDataFrame(rows, "parent int, child int")).collect()} == want
    assert len(rounds) <= 3


def test_words_are_counted_where_texts_are_read(spark):
    texts = [(i % 290, " ".join("abcde"[j % 5] for j in range(i % 7))) for i in range(300)] + [(500, None)]
    got = Counter()
    rows = content_model._counted(spark.createDataFrame(texts, "id int, text string").coalesce(1), "id")
    for r in rows.collect():
        got[r["id"], r["word"]] += r["n"]
    assert got == Counter((i, w) for i, t in texts for w in (t or "").split())
    assert "Exchange" not in plan(rows) and "Aggregate" not in plan(rows)


def test_blocks_are_made_slice_by_slice_of_any_batches():
    docs = [(9 - i, i // 3, ["a"] * i + ["b"]) for i in range(10)] + [(11, 4, [])]
    for size in (1, 2, 4, 11):
        parts = [docs[i : i + size] for i in range(0, len(docs), size)]
        batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*p), (pa.int64(), pa.int64(), pa.list_(pa.string())))], names=["id", "slice", "terms"]) for p in parts]
        got = {(r["term"], r["slice"]): r for b in inverted._blocks(batches) for r in b.to_pylist()}
        for (term, at), r in got.items():
            want = sorted((i, t.count(term), len(t)) for i, s, t in docs if s == at and term in t)
            assert list(zip(r["ids"], r["tfs"], r["lens"])) == want
            assert (r["n"], r["max_tf"], r["min_len"]) == (len(want), max(x[1] for x in want), min(x[2] for x in want))
        assert set(got) == {(w, s) for _, s, t in docs for w in t}


def test_words_are_hashed_once_a_process(monkeypatch):
    def plain(text, n):
        v = [0.0] * n
        for word in (text or "").lower().split():
            h = int.from_bytes(hashlib.sha256(word.encode()).digest()[:8], "big")
            v[h % n] += 1.0 if h >> 63 else -1.0
        norm = math.sqrt(sum(x * x for x in v))
        return [x / norm for x in v] if norm else v

    texts = [None, "", " ", *(" ".join(f"W{i * j % 97}é" for j in range(i)) for i in range(60))]
    want = {n: [plain(t, n) for t in texts] for n in (1, 7, 64)}
    monkeypatch.setattr(ask, "HASHES", 50)  # fewer than there are: begun anew
    assert all(ask.HashingEmbedder(n).embed(texts) == want[n] for n in want) and ask.HashingEmbedder().embed([]) == []
    monkeypatch.setattr(ask, "HASHES", 1 << 10)
    ask.HashingEmbedder().embed(texts)
    monkeypatch.setattr(ask.hashlib, "sha256", None)
    assert ask.HashingEmbedder(64).embed(texts) == want[64]


def test_an_index_run_shuffles_no_texts_for_paths(spark):
    files = spark.createDataFrame([(1, "a/b.txt", "text/plain", "word " * 2_000), (2, "x.go", "text/x-go", "func {")], "id bigint, path string, content_type string, content string")
    chunks = indexing.prepare_chunks(files, "p", "s", "v")
    assert "Join" not in plan(chunks) and "Exchange" not in plan(chunks)
    rows = chunks.select("file_id", "path", "chunk_key", "error").collect()
    assert {(r["file_id"], r["path"]) for r in rows} == {(1, "a/b.txt"), (2, "x.go")}
    assert all((r["chunk_key"] is None) == (r["file_id"] == 2) == (r["error"] is not None) for r in rows)


def test_slices_of_a_segment(spark, tmp_path):
    docs = spark.range(600).selectExpr("id", "concat('the w', id % 50) as text").coalesce(1)
    for size, slices in ((128, 5), (512, 2)):
        inverted.add(docs, str(tmp_path / str(size)), "a", 8, size)
        found = inverted.Index(spark, str(tmp_path / str(size)))
        assert found.blocks(["the"]).count() == slices and found.documents == 600
        assert {r["id"] for r in found.best(["w7"], 3).collect()} == {7, 57, 107}


def test_lines_of_a_directory_are_cut_by_many_tasks(spark):
    rows = spark.range(4_000).selectExpr("'s' as g", "format_string('%05d', (id * 7) % 4000) as path", "repeat('x', 30 + cast(id % 9 as int)) as line")
    want = "\n".join(r["line"] for r in rows.orderBy("path").collect()).encode()
    got = summaries.bounded_body(rows, ["g"], 8_000)
    assert "_part" in plan(got)
    (body,) = [r["body"] for r in got.collect()]
    assert want.startswith(body.encode()) and 7_900 < len(body) <= 8_000


def test_scoped_calls_are_dealt_to_a_number_of_tasks(spark):
    calls = spark.range(3_000).selectExpr("-id as from_id", "cast(id % 700 as string) as scope", "cast(null as string) as package", "'q' as qualifier", "concat('n', id % 50) as symbol", "'call' as dep_type")
    imports = spark.range(700).selectExpr("cast(id as string) as scope", "'q' as alias", "concat('x/p', id % 3) as path")
    symbols = spark.range(150).selectExpr("id + 1 as id", "concat('p', id % 3) as package", "concat('n', id % 50) as name")
    got = scopes.edges(calls, imports, symbols)
    assert got.rdd.getNumPartitions() == lineage.tasks(spark)  # few bytes, and yet not one task
    want = {(-i, min(k + 1 for k in range(150) if k % 3 == i % 700 % 3 and k % 50 == i % 50), f"n{i % 50}") for i in range(3_000)}
    assert {(r["from_id"], r["to_id"], r["symbol"]) for r in got.collect()} == want and got.count() == 3_000
