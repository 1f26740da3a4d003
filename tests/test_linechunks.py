"""The DataFrame chunkers against the Python ones, on random documents of all kinds of lines."""

import random

import pytest

from tessera.operators import chunking, linechunks
from tessera.operators.chunking import Limits

PYTHON = {"plain": chunking.plain, "markdown": chunking.markdown, "source": chunking.source_code}


def documents(seed, n=60):
    rnd, out = random.Random(seed), []
    kinds = ["", "# head", "  ## indented", "```", " ```go", "| a | b |", "x | y", "word " * 7, "w" * 40, "func name(a int) {", "  call(x)", "class A:", "\tdef f", "é日𝄞 " * 5, "#", "a", "\xa0# not plain", "\x1c"]
    for i in range(n):
        lines = [rnd.choice(kinds) for _ in range(rnd.choice([0, 1, 2, 30, 80, 400 if i < 4 else 10]))]
        out.append((i, "\n".join(lines)))
    return out + [(900, None), (901, ""), (902, "\n"), (903, "x" * 5_000), (904, "\n".join(["y" * 900] * 20)), (905, "```\n" + "z" * 300 + "\n" + "\n".join("t" * 50 for _ in range(40)))]


@pytest.mark.parametrize("how", PYTHON)
@pytest.mark.parametrize("limits", [Limits(60, 0, 30, 8), Limits(40, 5, 25, 30), Limits(12, 1, 9, 1), Limits()], ids=str)
def test_equals_the_python_chunkers(spark, how, limits):
    docs = documents(7)
    df = spark.createDataFrame(docs, "id bigint, content string").repartition(3)
    got = {}
    for r in linechunks.chunks(df, how, limits).collect():
        got.setdefault(r["id"], []).append((r["ordinal"], r["start_line"], r["end_line"], r["content"], r["token_count"]))
    for i, text in docs:
        want = [(n, c.start, c.end, c.content, c.tokens) for n, c in enumerate(PYTHON[how](text or "", limits))]
        assert sorted(got.get(i, [])) == want, (i, how)


def test_plan(spark):
    df = spark.createDataFrame(documents(1), "id bigint, content string")
    for how in PYTHON:
        plan = linechunks.chunks(df, how)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "ArrowEval" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    with pytest.raises(ValueError):
        linechunks.chunks(df, "plain", Limits(merge_small=True))
    assert linechunks.chunks(df.limit(0)).count() == 0
