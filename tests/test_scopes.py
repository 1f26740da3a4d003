"""Calls resolved by package and import table against plain Python (H-11)."""

import random

from tessera.operators import scopes

CALLS = "from_id long, scope string, package string, qualifier string, symbol string, dep_type string"
IMPORTS = "scope string, alias string, path string"
SYMBOLS = "id long, package string, name string"


def make(spark, calls, imports, symbols):
    return spark.createDataFrame(calls, CALLS), spark.createDataFrame(imports, IMPORTS), spark.createDataFrame(symbols, SYMBOLS)


def brute(calls, imports, symbols):
    packages = {p for _, p, _ in symbols if p is not None}

    def home(path):
        fits = [p for p in packages if ("/" + path).endswith("/" + p)]
        return max(fits, key=len) if fits else None

    table = {}
    for scope, alias, path in imports:
        if path is not None and scope is not None and home(path):
            key = scope, alias or path.split("/")[-1]
            table[key] = min(table.get(key, home(path)), home(path))
    out = set()
    for caller, scope, package, qualifier, name, kind in calls:
        target = table.get((scope, qualifier)) if qualifier else package
        fits = [i for i, p, n in symbols if p == target and n == name and p is not None and n is not None]
        out.add((caller, kind, target, name, min(fits, default=None), len(fits)))
    return out


def test_random_repositories(spark):
    r = random.Random(7)
    packages = ["core/search", "search", "internal/core/search", "core", "store", "a/b/c/d", "", None]
    symbols = [(i, r.choice(packages), r.choice(["Run", "Open", "Close", "run", None])) for i in range(60)]
    paths = ["example.org/x/internal/core/search", "example.org/x/core/search", "y/search", "research", "fmt", "core", "x/a/b/c/d", "b/c/d", None]
    imports = [(r.choice("fgh"), r.choice([None, "", "s", "t", "search"]), r.choice(paths)) for _ in range(25)]
    calls = [(r.randrange(40), r.choice(["f", "g", "h", None]), r.choice(packages), r.choice([None, "", "s", "t", "search", "fmt", "core"]), r.choice(["Run", "Open", "run", None]), r.choice(["call", "type"])) for _ in range(400)]
    got = [tuple(x) for x in scopes.resolved(*make(spark, calls, imports, symbols)).collect()]
    assert set(got) == brute(calls, imports, symbols) and len(got) == len(set(got))
    assert any(x[4] is not None for x in got) and any(x[4] is None for x in got) and any(x[5] > 1 for x in got)
    links = {(x.from_id, x.to_id, x.dep_type, x.symbol) for x in scopes.edges(*make(spark, calls, imports, symbols)).collect()}
    assert links == {(a, to, kind, name) for a, kind, _, name, to, _ in got if to is not None and a != to}


def test_longest_suffix_by_whole_segments(spark):
    paths = spark.createDataFrame([("x/core/search",), ("x/research",), ("search",), ("x/core/search/v2",)], "path string")
    packages = spark.createDataFrame([("search",), ("core/search",), ("re/search",)], "package string")
    assert {(x.path, x.package) for x in scopes.packages_of(paths, packages).collect()} == {("x/core/search", "core/search"), ("search", "search")}


def test_hot_symbol_is_linear_and_spread(spark):
    """A third of all calls and more name one symbol, which twenty files define: an edge a call, over many keys."""
    calls = [(1000 + i, "f", "p", None, "log" if i % 2 else f"n{i}", "call") for i in range(4000)]
    symbols = [(i, "p", "log") for i in range(20)] + [(100 + i, "p", f"n{i}") for i in range(0, 800, 2)]
    c, i, s = make(spark, calls, [], symbols)
    assert scopes.edges(c, i, s).count() == 2000 + 400
    plan = scopes.resolved(c, i, s)._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan and "Join LeftOuter, (((package" in plan and "Cartesian" not in plan


def test_empty(spark):
    assert scopes.resolved(*make(spark, [], [], [])).count() == 0
    got = scopes.resolved(*make(spark, [(1, None, None, None, None, None)], [], [])).collect()
    assert [(x.to_id, x.candidates) for x in got] == [(None, 0)]
