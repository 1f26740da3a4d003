"""Daily partials that merge: percentiles within one percent of rank, days merged late, missed targets."""

import datetime

import numpy as np

from tessera.operators import kpis

MONDAY = datetime.datetime(2024, 1, 1, 9)


def test_sketches_of_days_merge(spark, tmp_path):
    values = np.random.default_rng(1).lognormal(5, 1.5, 40_000)
    rows = [(MONDAY + datetime.timedelta(days=i % 11, minutes=i % 500), float(x)) for i, x in enumerate(values)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, score double").repartition(4)
    late = "day = DATE '2024-01-03'"
    days = kpis.daily_scores(df)
    days.filter(f"not ({late})").write.parquet(f"{tmp_path}/days")
    days.filter(late).write.mode("append").parquet(f"{tmp_path}/days")
    got = {r["week"]: r for r in kpis.drift(spark.read.parquet(f"{tmp_path}/days")).collect()}
    assert set(got) == {"2024-01-01", "2024-01-08"}
    for week, r in got.items():
        mine = np.sort([x for ts, x in rows if (ts.date() < datetime.date(2024, 1, 8)) == (week == "2024-01-01")])
        assert r["n"] == len(mine) and r["low"] == round(mine[0], 4) and r["high"] == round(mine[-1], 4)
        for p, q in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9)):
            assert abs(np.searchsorted(mine, r[p]) / len(mine) - q) < 0.01


def test_missed_targets(spark):
    rows = []
    for week in range(3):
        for i in range(100):
            rows.append((MONDAY + datetime.timedelta(weeks=week, days=i % 7), 0 if i < (30 if week else 5) else 2, i < 50, None if i < 90 else i < 99, i < 10, 3000.0 if week == 2 and i < 20 else 100.0))
    log = spark.createDataFrame(rows, "ts timestamp_ntz, hits int, cached boolean, liked boolean, requery boolean, latency_ms double")
    periods = kpis.merged(kpis.daily(log))
    got = [(r["period"].isoformat(), r["kpi"], r["grave"]) for r in kpis.missed(periods, "P0").orderBy("period", "kpi").collect()]
    assert got == [("2024-01-08", "success_rate", False), ("2024-01-15", "p95_ms", False), ("2024-01-15", "success_rate", True)]
    first = periods.orderBy("period").first()
    assert (first["success_rate"], first["cache_rate"], first["like_rate"], first["requery_rate"], first["p95_ms"]) == (0.95, 0.5, 0.9, 0.1, 100.0)
    assert kpis.missed(kpis.merged(kpis.daily(log.limit(0)))).count() == 0
