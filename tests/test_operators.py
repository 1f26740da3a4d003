"""Properties and small cases of the operators that the driver's tables don't reach."""

import subprocess

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text, vector
from tessera.operators import ask, catalog, chunking, coverage, gocode, graph, indexing, ranking, search, summaries
from tessera.sources import content_type, ignore, repository
from tessera.streaming import edits

LIMITS = chunking.Limits()


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def values(df):
    return sorted(map(tuple, df.collect()), key=str)


# chunkers


def test_limits():
    assert (LIMITS.most, LIMITS.least, LIMITS.target, LIMITS.overlap) == (1600, 100, 800, 200)


def test_plain_text():
    line = "fifteen words are in this line so that it has about ninety characters in it"
    chunks = chunking.plain("\n".join([line] * 200))
    assert len(chunks) >= 2 and all(100 <= c.tokens <= 1600 for c in chunks)
    assert chunking.plain("a short sentence.") == []
    assert chunking.plain("") == []
    for a, b in zip(chunks, chunks[1:]):
        assert a.start < b.start <= a.end + 1  # the carried lines overlap


def test_plain_text_emits_the_carried_tail():
    text_ = "\n".join(["x" * 399] * 8)  # the target is met on the last line
    chunks = chunking.plain(text_)
    assert [(c.start, c.end) for c in chunks] == [(1, 8), (7, 8)]


def test_small_pieces_are_dropped_or_merged():
    text_ = "# A\n" + "word " * 200 + "\n# B\ntiny"
    assert [(c.start, c.end) for c in chunking.markdown(text_)] == [(1, 2)]
    assert [(c.start, c.end) for c in chunking.markdown(text_, chunking.Limits(merge_small=True))] == [(1, 4)]


def test_markdown_keeps_fences_and_tables_whole():
    body = ("para " * 120 + "\n") * 3
    fence = "```\n" + ("code line " * 10 + "\n") * 30 + "# no heading\n```\n"
    rows = "\n".join(["| a | b |"] * 400)
    text_ = f"# One\n{body}{fence}## Two\n{body}{rows}\n\n# Three\n{body}"
    chunks = chunking.markdown(text_)
    for c in chunks:
        assert c.content.count("```") % 2 == 0
        assert c.content == "\n".join(text_.split("\n")[c.start - 1 : c.end])
    bars = [i + 1 for i, x in enumerate(text_.split("\n")) if "|" in x]
    assert sum(c.start <= bars[0] and bars[-1] <= c.end for c in chunks) == 1


def test_bar_before_heading_sign_is_a_table():
    text_ = "# A\n" + "word " * 120 + "\n# b | c\n" + "word " * 120
    assert [(c.start, c.end) for c in chunking.markdown(text_)] == [(1, 4)]


def test_source_code_splits_at_calls_too():
    part = "  x = 1\n" * 80
    text_ = f"def f():\n{part}if (a)\n{part}foo(x)\n{part}"
    assert [c.start for c in chunking.source_code(text_)] == [1, 82, 163]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab |#`\t", max_size=80), max_size=60), st.sampled_from([chunking.plain, chunking.markdown, chunking.source_code]))
def test_chunks_are_ordered_ranges_of_lines(lines, cut):
    text_ = "\n".join(lines)
    limits = chunking.Limits(most=60, least=5, target=30, overlap=10)
    last = 0
    for c in cut(text_, limits):
        assert c.end >= c.start > last or cut is chunking.plain
        assert c.content == "\n".join(text_.split("\n")[c.start - 1 : c.end]) and c.tokens == chunking.estimate(c.content) >= 5
        last = c.start


def test_trim():
    assert chunking.trim("short", 100) == "short"
    for t, n in (("word " * 2000, 1600), ("日本語" * 50, 30)):
        assert n - 1 <= chunking.estimate(chunking.trim(t, n)) <= n


def test_chunk_files(spark):
    files = table(spark, [(1, "text/markdown", "# A\n" + "w " * 300), (2, "text/x-go", "func f( {"), (3, "text/x-go", "package a\n\nfunc Run(ctx Context) error {\n\treturn work(ctx, 1, 2, 3)\n}\n"), (4, "text/plain", None), (5, "text/x-python", "def f():\n" + " y\n" * 300)], "id bigint, content_type string, content string")
    got = {r["file_id"]: r for r in chunking.chunk_files(files).collect()}
    assert set(got) == {1, 2, 3, 5} and got[2]["error"] and got[3]["chunk_name"] == "Run" and got[1]["level"] == 2


# Go


SOURCE = """// Package calc adds.
package calc

import (
	"fmt"
	"golang.org/x/net"
	"github.com/x/y"
)

// Calc holds.
type Calc struct {
	Log *log.Logger
}

type (
	A interface {
		Do(x Foo) error
	}
	B int
)

// Add adds.
func (c *Calc) Add(n Num) (int, error) {
	s := "}" // }
	if err := check(n); err != nil && n > 0 {
		return 0, err
	}
	// then
	for i := 0; i < 3; i++ {
		fmt.Println(helper(s))
	}
	x.y = 2
	return c.Value, nil
}

const X = 1
"""


def test_declarations():
    got = [(d.kind, d.name, d.parent, d.start, d.end) for d in gocode.declarations(SOURCE)]
    assert got == [("package", "calc", None, 2, 2), ("struct", "Calc", None, 11, 13), ("interface", "A", None, 16, 18), ("type", "B", None, 19, 19), ("method", "Add", "Calc", 23, 34), ("const", "X", None, 36, 36)]
    add = next(d for d in gocode.declarations(SOURCE) if d.name == "Add")
    assert add.doc == "Add adds." and add.calls == ["check", "fmt.Println", "helper"] and "Num" in add.types and add.signature == "Add (n Num) int, error"
    assert [b[0] for b in gocode.logic_blocks(add)] == ["initialization", "error_handling", "loop", "assignment"]


@pytest.mark.parametrize(
    "head, want",
    [
        ("func f()", "f ()"),
        ("func (c *Calc) Do(a, b int, m map[string][]*pkg.T) error", "Do (a int, b int, m map[string][]*pkg.T) error"),
        ("func g(int, ...string) (n int, err error)", "g (int, unknown) n int, err error"),
        ("func h[T any](f func(a int) T, c chan int) interface{}", "h (f unknown, c unknown) interface{}"),
        ("func k(a [4]byte, x interface{ M() }) []struct{ A int }", "k (a []byte, x interface{}) []unknown"),
    ],
)
def test_signatures(head, want):
    assert gocode.signature(head) == want


@pytest.mark.parametrize("path, standard", [("net/http", True), ("network.example/x", False), ("golang.org/x/net", True), ("golang.org/y", False), ("github.com/a/b", False), ("mypkg/sub", True), ("go/ast", True), ("goji.io/x", False), ("encoding/json.v2", True)])
def test_standard_paths(path, standard):
    assert gocode.is_standard(path) == standard


def test_imports():
    assert gocode.imports(SOURCE) == {"standard": ["fmt", "golang.org/x/net"], "external": ["github.com/x/y"]}


def test_metrics():
    code = "func f() {\n\n// a\n/* b */\n/* c\nd\n*/\nif a && b || c {\n}\nfor {\n}\nswitch x {\ncase 1:\ndefault:\n}\n}"
    assert gocode.line_counts(code) == (10, 5 / 15)
    assert gocode.complexity(code) == 7
    assert gocode.line_counts("") == (0, 0.0)


def test_broken_source_is_an_error():
    for bad in ("func a() {", "func a() )", "x ]"):
        with pytest.raises(gocode.ParseError):
            list(gocode.declarations(bad))


def test_long_functions_are_split():
    body = "\n".join(f"\tif theValueOfThing{i} > theOtherValueOfThing{i} {{\n\t\tdoSomethingLong(a{i}, b{i}, c{i}, d{i}, e{i})\n\t\tdoSomethingElse(a{i}, b{i}, c{i}, d{i}, e{i}, f{i}, g{i})\n\t\tandMoreOfTheSame(a{i}, b{i}, c{i}, d{i}, e{i}, f{i}, g{i}, h{i}, i{i}, j{i}, k{i}, l{i}, m{i}, n{i}, o{i}, p{i}, q{i}, r{i}, s{i})\n\t}}" for i in range(17))
    got = gocode.chunks(f"package a\n\nfunc Big() {{\n{body}\n}}\n", chunking.estimate)
    assert [d.level for d in got].count(3) == 17 and all(50 <= d.tokens <= 800 for d in got if d.level == 3)


def test_file_summary():
    got = gocode.file_summary(SOURCE, "Go", chunking.estimate)
    assert all(x in got for x in ("Language: Go", "Components:", "Dependencies:", "Description: Package calc adds."))
    assert got.index("github.com/x/y") < got.index("- fmt")
    many = "package a\nimport (\n" + "\n".join(f'"p{i}"' for i in range(50)) + "\n)\n" + "\n".join(f"func F{i}() {{}}" for i in range(100))
    assert chunking.estimate(gocode.file_summary(many, "Go", chunking.estimate)) <= 400
    assert "Language: Go" in gocode.file_summary("func (", "Go", chunking.estimate)
    assert "f" in gocode.file_summary("# top\ndef f(): pass", "python", chunking.estimate)


# tables with keys


def test_insert_conflicts(spark):
    old = table(spark, [(1, "a"), (2, None)], "id int, name string")
    assert catalog.insert(old, table(spark, [(3, "b"), (4, None), (5, None)], "id int, name string"), ["name"]).count() == 5
    for bad in ([(9, "a")], [(9, "z"), (8, "z")]):
        with pytest.raises(catalog.ConflictError):
            catalog.insert(old, table(spark, bad, "id int, name string"), ["name"])
    with pytest.raises(catalog.CheckError):
        catalog.check(old, F.col("id") > 1, "small")


def test_upsert_and_delete(spark):
    old = table(spark, [(1, "a", 1), (2, "b", 2)], "id int, name string, at int")
    new = table(spark, [(2, None, 9), (3, "c", 3)], "id int, name string, at int")
    assert values(catalog.upsert(old, new, ["id"], keep=["at"])) == [(1, "a", 1), (2, None, 2), (3, "c", 3)]
    assert values(catalog.delete(old.withColumn("x", F.when(F.col("id") == 1, 1)), F.col("x") == 1).drop("x")) == [(2, "b", 2)]


def test_publish(spark, tmp_path):
    root = str(tmp_path / "t")
    catalog.publish(spark.range(3), root, "1")
    catalog.publish(catalog.current(spark, root).filter("id > 0"), root, "2")
    assert values(catalog.current(spark, root)) == [(1,), (2,)]


def test_failure_gate(spark):
    rows = table(spark, [(i, i < 3) for i in range(10)], "id int, failed boolean")
    assert coverage.check_failure_rate(rows) == (10, 3)
    with pytest.raises(coverage.FailureRateError):
        coverage.check_failure_rate(rows.filter("id < 9"))


# graphs


def edges(spark, rows):
    return table(spark, rows, "parent string, child string, ordinal bigint")


def test_links(spark):
    e = edges(spark, [("r", "a", 0)])
    assert graph.link(e, edges(spark, [("r", "b", 1)])).count() == 2
    for bad in (("r", "r", 0), ("r", None, 0), ("r", "x", -1)):
        with pytest.raises(catalog.CheckError):
            graph.link(e, edges(spark, [bad]))
    with pytest.raises(catalog.ConflictError):
        graph.link(e, edges(spark, [("r", "a", 5)]))


def test_paths_and_depths(spark):
    e = edges(spark, [("r", "a", 0), ("a", "b", 0), ("b", "c", 0), ("x", "y", 0), ("y", "x", 0)])
    got = {r["node"]: (r["path"], r["cyclic"]) for r in graph.paths(e).collect()}
    assert got["c"] == (["c", "b", "a", "r"], False) and got["x"][1] and got["y"][1]
    depth = {r["node"]: (r["root"], r["depth"]) for r in graph.path_to_root(e).collect()}
    assert depth == {"r": ("r", 0), "a": ("r", 1), "b": ("r", 2), "c": ("r", 3), "x": (None, None), "y": (None, None)}


def test_subtree_of_a_diamond(spark):
    e = edges(spark, [("r", "b", 1), ("r", "a", 0), ("a", "d", 5), ("b", "d", 0), ("d", "e", 0), ("e", "r", 0)])
    got = [(r["node"], r["depth"]) for r in graph.subtree(e, "r", 9).collect()]
    assert got == [("r", 1), ("a", 2), ("d", 3), ("e", 4), ("b", 2)]
    assert graph.subtree(e, "r", 0).count() == 0 and graph.subtree(e, "r", 1).count() == 1
    assert {r["node"] for r in graph.cycle_nodes(e).collect()} == {"r", "a", "b", "d", "e"}
    assert graph.cycle_nodes(edges(spark, [("r", "a", 0), ("r", "b", 1), ("a", "d", 0), ("b", "d", 0)])).count() == 0


# functions and sources


def test_scores(spark):
    rows = table(spark, [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [-2.0, 0.0]), (4, [1.0]), (5, None)], "id int, v array<float>")
    got = {r["id"]: r["s"] for r in rows.select("id", vector.score(F.col("v"), vector.literal([3.0, 0.0])).alias("s")).collect()}
    assert got == {1: 1.0, 2: None, 3: -1.0, 4: None, 5: None}


def test_merkle_order_does_not_matter(spark):
    a = table(spark, [("x",), ("y",), ("z",)], "h string")
    one, two = (d.agg(text.merkle(F.collect_list("h")).alias("m")).first()["m"] for d in (a, a.orderBy(F.desc("h"))))
    assert one == two


def test_source_names(spark):
    rows = table(spark, [("git@github.com:a/b.git",), ("https://github.com:443/a/b.git",), ("ssh://git@host:22/a/b",), ("plain.git",)], "u string")
    assert [r["s"] for r in rows.select(text.source_name(F.col("u")).alias("s")).collect()] == ["github.com/a/b", "github.com/a/b", "host/a/b", "plain"]


def test_stale_latest_and_checks(spark):
    rows = table(spark, [("s1", "a", True, None, 5), ("s2", "a", True, 3, 1), ("s3", "a", False, 9, 9), ("s4", "b", False, 1, 1), ("s5", "c", True, 3, 1), ("s6", "c", True, 3, 1)], "id string, source_id string, indexed boolean, indexed_at int, created_at int")
    assert values(search.latest_snapshots(rows).select("source_id", "id")) == [("a", "s2"), ("c", "s5")]
    assert search.check_search("q", product_id=1, source_id=2) == "product" and search.check_hybrid("q", snapshot_id=1) == "snapshot"
    for call in (lambda: search.check_search(" ", 1), lambda: search.check_search("q"), lambda: search.check_hybrid("q", 1, 2)):
        with pytest.raises(search.SearchError):
            call()
    assert search.limit_or(0) == search.limit_or(None) == 10 and search.limit_or(3) == 3


def test_ignore_and_types(spark):
    rows = table(spark, [("x/.env.a.local",), ("a/vendor/b.go",), ("ok.go",), ("docs/.vuepress/dist/x",), ("my.keys",)], "p string")
    assert [r["i"] for r in rows.select(ignore.ignored(F.col("p")).alias("i")).collect()] == [True, True, False, True, False]
    assert content_type.registry(spark).filter("has_parser").count() == 1
    sniff = table(spark, [("x", bytearray(b"\x00\x01")), ("x", bytearray(b"<html>")), ("x", bytearray(b"hi"))], "p string, c binary")
    assert [r["t"] for r in sniff.select(content_type.content_type(F.col("p"), F.col("c")).alias("t")).collect()] == ["application/octet-stream", "text/html", "text/plain"]


def test_repository(spark, tmp_path):
    repo = str(tmp_path)

    def git(*a):
        subprocess.run(["git", "-C", repo, "-c", "user.name=n", "-c", "user.email=e", *a], check=True, capture_output=True)

    git("init", "-q", "-b", "main")
    for n, files in enumerate(({"a.go": "1", "d/b.md": "x"}, {"a.go": "2"}, {"c.txt": "z"})):
        for name, body in files.items():
            (tmp_path / name).parent.mkdir(exist_ok=True)
            (tmp_path / name).write_text(body)
        git("add", ".")
        git("commit", "-qm", str(n))
    git("tag", "v1")
    docs = repository.documents(spark, repo, "v1")
    assert {r["path"]: bytes(r["content"]) for r in docs.collect()} == {"a.go": b"2", "d/b.md": b"x", "c.txt": b"z"}
    assert docs.filter("content_hash = sha2(content, 256)").count() == 3
    log = repository.history(spark, repo)
    assert {r["path"]: r["edits"] for r in summaries.edit_frequency(log, "2000-01-01").collect()} == {"a.go": 2, "d/b.md": 1, "c.txt": 1}
    assert {r["path"]: r["hash"] for r in summaries.last_commit(log).collect()}["c.txt"] == repository.resolve(repo, "main")
    with pytest.raises(ValueError):
        repository.resolve(repo, "nope")


# models, prompts, streams


def test_embedding(spark):
    rows = table(spark, [(1, "alpha beta gamma delta"), (2, ""), (3, None)], "id int, content string")
    got = {r["id"]: r["vector"] for r in ask.embed(rows, ask.HashingEmbedder(64)).collect()}
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-6 and got[2] == got[3] == [0.0] * 64


def test_retries():
    waits, calls = [], []

    def call(fail):
        calls.append(1)
        if len(calls) <= fail:
            raise ask.RateLimited
        return "ok"

    assert ask.with_retry(lambda: call(3), waits.append, lambda: 0.0) == "ok" and waits == [2.0, 4.0, 8.0]
    calls.clear()
    with pytest.raises(ask.RateLimited):
        ask.with_retry(lambda: call(9), waits.append, lambda: 0.0)
    with pytest.raises(KeyError):
        ask.with_retry(lambda: {}["x"], waits.append)


def test_ask_and_wiki(spark, tmp_path):
    hits = table(spark, [(1, "a.go", "code", 0.5), (2, "b.go", "more", 0.9)], "chunk_id bigint, path string, content string, score double")
    got = ask.ask("why?", hits, hits.limit(0))
    assert got["answer"].index("b.go") < got["answer"].index("a.go") and "(nothing found)" in got["answer"] and [s["chunk_id"] for s in got["sources"]] == [2, 1]

    def page(section):
        if section == "data_flow":
            raise RuntimeError("down")
        return f"# {section}"

    written = ask.wiki(page, str(tmp_path / "w"))
    assert len(written) == 4 and "down" in open(written["data_flow"]).read()


def test_metrics_of_a_perfect_ranking(spark):
    ranked = table(spark, [("q", i, i) for i in range(1, 21)], "query_id string, rank int, id int")
    relevant = table(spark, [("q", i) for i in range(1, 6)], "query_id string, id int")
    assert values(ranking.retrieval_metrics(ranked, relevant)) == [("q", 1.0, 1.0, 1.0, 3.0)]


def test_summaries_follow_changes(spark):
    now = table(spark, [("a", "1", "x"), ("b", "2", "y")], "path string, source_hash string, body string")
    old = table(spark, [("a", "1", "old", "h"), ("b", "0", "old", "h")], "path string, source_hash string, content string, content_hash string")
    got = {r["path"]: r["content"] for r in summaries.summarise(now, old, F.upper).collect()}
    assert got == {"a": "old", "b": "Y"}
    dirs = table(spark, [("s", "h1", 3), ("s", "h2", 4)], "snapshot_id string, hash string, files int")
    assert {r["files"] for r in summaries.architecture(dirs, lambda c: c).collect()} == {7}


def test_stream_equals_batch(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "ck")
    rows = table(spark, [("a", "2024-01-01 10:00:00"), ("a", "2024-01-02 10:00:00"), ("b", "2024-01-20 00:00:00")], "path string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(src)
    stream = edits.edit_windows(spark.readStream.schema(rows.schema).parquet(src))
    q = stream.writeStream.format("memory").queryName("edit_windows_out").outputMode("complete").option("checkpointLocation", out).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert values(spark.table("edit_windows_out")) == values(edits.edit_windows(rows))


def test_incremental_index(spark, tmp_path):
    seen = []
    rows = table(spark, [("a", "2024-01-01", 1), ("a", "2024-01-02", 2), ("b", "2024-01-01", 3)], "path string, ts string, v int")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    edits.index_changes(stream, lambda df: seen.extend((r["path"], r["v"]) for r in df.collect()), str(tmp_path / "ck")).awaitTermination(120)
    assert sorted(seen) == [("a", 2), ("b", 3)]


def test_index(spark, tmp_path):
    long = ("word " * 30 + "\n") * 20
    docs = table(spark, [("a.go", SOURCE), ("bad.go", "func ("), ("docs/b.md", f"# T\n{long}"), ("x.png", "no"), ("e.txt", "")], "path string, content string").withColumn("content", F.col("content").cast("binary"))
    root = str(tmp_path / "index")
    got = indexing.index(docs, root, "p", "s", "v1")
    assert (got.files, got.failed, got.skipped) == (4, 1, False) and got.chunks >= 3
    chunks = spark.read.parquet(f"{root}/chunks")
    assert chunks.filter("chunk_key like 'p/s/docs/b.md#L1-L%@v1'").count() == 1
    assert spark.read.parquet(f"{root}/embeddings").count() == got.chunks == chunks.select("id").filter("error is null").distinct().count()
    assert indexing.index(docs, root, "p", "s", "v1").skipped
    assert sum(r["failed"] for r in indexing.stats(chunks).collect()) == 1
    with pytest.raises(coverage.FailureRateError):
        indexing.index(docs, root, "p", "s", "v2", most_failed=0.1)
    assert not indexing.indexed(spark, root, "s@v2")


def summary_files(spark):
    rows = [("s", "a/b/x.go", "h1", "one"), ("s", "a/b/y.go", "h2", "two"), ("s", "a/z.go", "h3", "three"), ("s", "top.go", "h4", "four")]
    return spark.createDataFrame(rows, "snapshot_id string, path string, content_hash string, content string")


NO_SUMMARIES = "summary_type string, target_path string, arch_type string, source_hash string, content string"


def test_summaries_of_files_directories_and_architecture(spark):
    files, calls = summary_files(spark), spark.sparkContext.accumulator(0)

    @F.udf("string")
    def model(body):
        calls.add(1)
        return f"<{body}>"

    none = spark.createDataFrame([], NO_SUMMARIES)
    first = summaries.summarise_all(files, none, model)
    got = {(r["summary_type"], r["target_path"], r["arch_type"]): r for r in first.collect()}
    assert len(got) == 4 + 3 + 4 and calls.value == 11
    assert got["directory", "a/b", None]["content"] == "<a/b/x.go: <one>\na/b/y.go: <two>>" and got["directory", "a/b", None]["depth"] == 2
    assert got["directory", "a", None]["content"] == f"<a/b: {got['directory', 'a/b', None]['content']}\na/z.go: <three>>"
    assert got["architecture", "", "data_flow"]["content"].startswith("<data_flow\n: <")
    # the same again: nothing is written; one file changed: it, what is above it, and the architecture are
    again = summaries.summarise_all(files, first, model)
    assert {(r["target_path"], r["content_hash"]) for r in again.collect()} == {(r["target_path"], r["content_hash"]) for r in got.values()} and calls.value == 11
    changed = files.withColumn("content_hash", F.when(F.col("path") == "a/z.go", "h9").otherwise(F.col("content_hash"))).withColumn("content", F.when(F.col("path") == "a/z.go", "nine").otherwise(F.col("content")))
    third = {(r["summary_type"], r["target_path"]): r["content"] for r in summaries.summarise_all(changed, first, model).collect()}
    assert calls.value == 11 + 1 + 2 + 4 and "nine" in third["directory", ""] and third["directory", "a/b"] == got["directory", "a/b", None]["content"]


def test_summary_gate_of_each_step(spark):
    none, files = spark.createDataFrame([], NO_SUMMARIES), summary_files(spark)
    one = summaries.summarise_all(files, none, lambda body: F.when(body != "one", body)).collect()  # one of four files fails: left out
    assert "a/b/x.go" not in {r["target_path"] for r in one} and len(one) == 3 + 3 + 4
    with pytest.raises(coverage.FailureRateError):
        summaries.summarise_all(files, none, lambda body: F.when(~body.isin("one", "two"), body))
    with pytest.raises(coverage.FailureRateError):  # the deepest directories, all of which fail
        summaries.summarise_all(files, none, lambda body: F.when(~body.startswith("a/b/"), body))


def test_hot_directories_have_bounded_bodies(spark):
    rows = spark.range(3_000).select(F.lit("s").alias("g"), F.format_string("%05d", "id").alias("path"), F.repeat(F.lit("x"), 40).alias("line"))
    (r,) = summaries.bounded_body(rows, ["g"], 8_000).collect()
    assert r["body"] == "\n".join(["x" * 40] * 195) and len(r["body"]) <= 8_000
    (r,) = summaries.bounded_body(spark.createDataFrame([("s", "p", "é" * 100)], "g string, path string, line string"), ["g"], 50).collect()
    assert r["body"] == "é" * 25


def test_summary_vectors_follow_contents(spark):
    none = spark.createDataFrame([], NO_SUMMARIES)
    first = summaries.summarise_all(summary_files(spark), none, lambda body: body)
    empty = spark.createDataFrame([], "summary_id bigint, content_hash string, vector array<float>")
    embed = lambda rows: ask.embed(rows, ask.HashingEmbedder(8))
    vectors = summaries.upsert_vectors(first, empty, embed)
    assert vectors.count() == vectors.select("summary_id").distinct().count() == 11
    seen = []
    summaries.upsert_vectors(first, vectors, lambda rows: seen.append(rows.count()) or embed(rows)).collect()
    assert seen == [0]


def test_wiki_from_section_contexts(spark, tmp_path):
    hits = lambda name: spark.createDataFrame([(1, f"{name}.go", f"{name} text", 0.5), (2, "b.go", "other", 0.75)], "chunk_id bigint, path string, content string, score double")
    asked = []
    contexts = ask.section_contexts(lambda q: asked.append(q) or (hits("code"), hits("summary")), ask.HashingEmbedder(4))
    assert len(asked) == 4 and contexts.count() == 4
    written = ask.generate_wiki(contexts, lambda prompt: prompt if "data_flow" not in prompt else 1 / 0, str(tmp_path / "wiki"))
    page = open(written["overview"]).read()
    assert "### 1. b.go (score 0.750)\nother" in page and "summary text" in page.split("## Code")[0] and "could not be generated" in open(written["data_flow"]).read()


@pytest.mark.parametrize("text, want", [("so:\n\n", True), ("a,", True), ("see the following", True), ("next: x", True), ("次の、もの", True), ("done.", False), ("below is x", False), ("", False), (None, None), ("x:\nend", False)])
def test_incomplete_endings(spark, text, want):
    from tessera.functions.text import incomplete_ending

    row = spark.createDataFrame([(text,)], "t string").select(incomplete_ending(F.col("t")).alias("x")).first()
    assert row["x"] == want


def test_go_tables(spark):
    files = spark.createDataFrame([(1, "Go", SOURCE), (2, "Go", "func ("), (3, "Go", None), (4, "Python", "import x\ndef f(): pass")], "id bigint, language string, content string")
    rows = gocode.describe(files).collect()
    assert [(r["kind"], r["name"]) for r in rows if r["id"] == 1] == [(d.kind, d.name) for d in gocode.declarations(SOURCE)]
    assert [r["error"] is not None for r in rows if r["id"] == 2] == [True] and not [r for r in rows if r["id"] == 3]
    assert [r["kind"] for r in gocode.logic(files).filter("id = 1").collect()] == ["initialization", "error_handling", "loop", "assignment"]
    assert {(r["path"], r["is_standard"]) for r in gocode.imported(files).filter("id = 1").collect()} == {("fmt", True), ("golang.org/x/net", True), ("github.com/x/y", False)}
    texts = {r["id"]: r["summary"] for r in gocode.summarised(files, len, 2_000).collect()}
    assert texts[1].startswith("Language: Go") and "f" in texts[4] and len(texts) == 4


def test_repository_by_slices(spark, tmp_path):
    repo = str(tmp_path / "many")
    run = lambda *a: subprocess.run(["git", "-C", repo, "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    subprocess.run(["git", "init", "-q", repo], check=True)
    for k in range(5):
        with open(f"{repo}/f{k}.txt", "wb") as f:
            f.write(b"\x00" * k + b"line\n" * k)
        with open(f"{repo}/same.txt", "w") as f:
            f.write(str(k))
        run("add", "-A")
        run("commit", "-qm", f"c{k}")
    spark.dataSource.register(repository.RepositorySource)
    spark.dataSource.register(repository.HistorySource)
    for size in ("2", "100"):
        files = spark.read.format("repository").option("path", repo).option("slice", size).load().collect()
        assert {r["path"]: bytes(r["content"]) for r in files} == {f"f{k}.txt": b"\x00" * k + b"line\n" * k for k in range(5)} | {"same.txt": b"4"}
        log = spark.read.format("repository_history").option("path", repo).option("slice", size).load().collect()
        assert sorted((r["event_id"], r["path"]) for r in log) == sorted((k, p) for k in range(5) for p in (f"f{k}.txt", "same.txt"))
    head = repository.resolve(repo)
    assert {r["path"] for r in search.by_key(repository.history(spark, repo), "hash", head).collect()} == {"f4.txt", "same.txt"}


def test_source_settings_and_costs(spark):
    assert repository.Settings.from_env({"TESSERA_CHUNK_WORKERS": "9", "OTHER": "1"}) == repository.Settings(chunk_workers=9)
    usage = spark.createDataFrame([("a", 2_000, 500), ("b", 1, 1)], "model string, input_tokens long, output_tokens long")
    prices = spark.createDataFrame([("a", 0.5, 2.0)], "model string, input_price double, output_price double")
    assert {r["model"]: r["cost"] for r in repository.cost(usage, prices).collect()} == {"a": 2.0, "b": None}


@pytest.mark.parametrize(
    "path, content, kind, language",
    [
        ("run", b"#!/usr/bin/env python3\nprint()", "text/x-python", "Python"),
        ("run", b"#!/bin/bash -e\n", "text/x-shellscript", "Shell"),
        ("run", b"#!/usr/bin/env -S node\n", "text/javascript", "JavaScript"),
        ("a.h", b"int f(void);\n", "text/x-c", "C"),
        ("a.h", b"#pragma once\nnamespace a {\n}\n", "text/x-c++", "C++"),
        ("x", b"%PDF-1.4", "application/pdf", None),
        ("x", b"\x89PNG\r\n\x1a\n", "image/png", None),
        ("x", b"\n <!DOCTYPE html><p>", "text/html", None),
        ("x", b"a\x00b", "application/octet-stream", None),
        ("x", b"", "text/plain", None),
        ("x.go", b"\x00", "text/x-go", "Go"),
        ("x", None, "text/plain", None),
    ],
)
def test_types_by_content(spark, path, content, kind, language):
    row = spark.createDataFrame([(path, bytearray(content) if content is not None else None)], "p string, c binary")
    got = row.select(content_type.content_type(F.col("p"), F.col("c")).alias("k"), content_type.language(F.col("p"), F.col("c")).alias("l")).first()
    assert (got["k"], got["l"]) == (kind, language)


def test_index_with_a_detector_and_a_collector(spark, tmp_path):
    docs = spark.createDataFrame([("a.txt", bytearray(b"func f() {\n" + b"\tif a && b {\n\t}\n" * 60 + b"}\n"))], "path string, content binary")
    seen = []
    got = indexing.index(docs, str(tmp_path), "p", "s", "v", detect=lambda path, content: (F.lit("text/x-python"), F.lit("Python")), measure=lambda rows: seen.extend(rows.collect()))
    assert got.chunks == 1 and spark.read.parquet(f"{tmp_path}/files").first()["language"] == "Python"
    assert len(seen) == 1 and seen[0]["files"] == 1 and seen[0]["max_complexity"] == 1 + 120
