"""Fill-in-middle against a plain-Python version, with texts of one stretch and of many."""

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import infilling, queries


def plain(doc_id, text, seed=1):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    hexes = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexes[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text, text
    if h4 % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


def rows_of(df):
    return Counter(tuple(r) for r in df.withColumn("restored", infilling.restored(F.col("output"), F.col("form"))).collect())


MARKED = ["<P>", "a <S> b", "x<M", "<<P", "tail <", "<S", "P>", "ab<M>cd"]


@pytest.mark.parametrize("stretch", [1, 7, 64, 1 << 20])
def test_equals_plain_version(spark, odd_rows, stretch):
    rows = [r for r in odd_rows if stretch > 1 or len(r[1] or "") < 200] + [(1000 + i, t * k) for i, t in enumerate(MARKED) for k in (1, 9)]
    docs = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id bigint, text string, n int, key string, form string").repartition(3)
    got = rows_of(infilling.fill_in_middle(docs, stretch=stretch))
    assert got == Counter(plain(i, t) for i, t in rows)
    assert {"plain", "psm", "spm"} == {r[2] for r in got}


def test_runs_and_code_points_across_stretches(spark):
    rows = [(i, "a" * i + "é日𝄞" * (i % 5) + "bc" * 9 + "é" * (i % 3)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for stretch in (3, 10):
        assert rows_of(infilling.fill_in_middle(docs, stretch=stretch)) == Counter(plain(*r) for r in rows)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab Z1é日𝄞\n<", max_size=40), st.lists(st.integers(0, 120), max_size=4))
def test_maps_compose(text, cuts):
    """Stretches cut anywhere, even within a code point, give together what the whole gives."""
    data = np.frombuffer(text.encode(), np.uint8)
    bounds = sorted({0, len(data), *(c for c in cuts if c < len(data))})
    inside, parts = False, []
    for a, b in zip(bounds, bounds[1:]):
        parts.append(infilling.begins(data[a:b], inside)[0])
        inside = bool(infilling._LETTER[data[b - 1]])
    whole = np.concatenate([np.zeros(0, bool), *parts])
    assert whole.tolist() == infilling.begins(data)[0].tolist()
    assert whole.sum() == len(re.findall("[A-Za-z]+|[^A-Za-z]", text))


def test_giant_documents_are_scanned_by_stretches(spark):
    """Copies of a giant text, and another with the same text and another id."""
    text = " ".join(f"word{k * 7919 % 100_003} é" for k in range(300_000))
    rows = [(1, text), (1, text), (2, text), (3, "short"), (None, text)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    made = infilling.fill_in_middle(docs, stretch=1 << 16)
    digest = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256), F.sha2(infilling.restored(F.col("output"), F.col("form")), 256))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert Counter(map(tuple, digest.collect())) == Counter((*p[:5], sha(p[5]), sha(p[6])) for p in (plain(*r) for r in rows))


def test_no_rows(spark):
    assert infilling.fill_in_middle(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = duck.sql(queries.ORACLES["op13_fill_in_middle"])
    got = queries.op13_fill_in_middle(spark, sf)
    assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(want.fetchall())
