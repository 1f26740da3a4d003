"""Search quality by stored daily partials (R-12, R-13): counts, and quantile sketches that merge.

``daily`` reduces a log to one row a day; the rows are kept, and a week's or a month's numbers come from them, not from the log.
Percentiles are KLL sketches: merging sketches of days gives the sketch of their union, so a late day is merged in and
nothing is read again.  A sketch has a fixed size; with ``K`` = 400 ranks are off by well under one percent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Size of the sketches.
K = 400
#: The targets of the three stages.
TARGETS = {
    "P0": {"success_rate": 0.80, "like_rate": 0.60, "requery_rate": 0.40, "p95_ms": 2000.0, "cache_rate": 0.20},
    "P1": {"success_rate": 0.85, "like_rate": 0.70, "requery_rate": 0.30, "p95_ms": 1500.0, "cache_rate": 0.30},
    "P2": {"success_rate": 0.90, "like_rate": 0.80, "requery_rate": 0.20, "p95_ms": 1000.0, "cache_rate": 0.40},
}
#: Of these less is better.
CEILINGS = ("requery_rate", "p95_ms")
_SUMS = ("searches", "found", "cached", "likes", "dislikes", "requeries")


def _day(ts: Column) -> Column:
    return F.date_trunc("day", ts).cast("date")


def daily(log: DataFrame) -> DataFrame:
    """A row a day of searches (ts, hits, cached, liked, requery, latency_ms); a missing opinion is none."""
    flag = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return log.groupBy(_day(F.col("ts")).alias("day")).agg(
        F.count("*").alias("searches"), flag(F.col("hits") > 0).alias("found"), flag(F.col("cached")).alias("cached"), flag(F.col("liked")).alias("likes"),
        flag(~F.col("liked")).alias("dislikes"), flag(F.col("requery")).alias("requeries"), F.kll_sketch_agg_double(F.col("latency_ms").cast("double"), K).alias("latency"),
    )


def merged(days: DataFrame, period: str = "week") -> DataFrame:
    """The numbers of each week (or month, ...) from its days: searches, rates and the 95th percentile of the latency."""
    begin = F.date_trunc(period, "day").cast("date").alias("period")
    sums = days.groupBy(begin).agg(*(F.sum(c).alias(c) for c in _SUMS), F.kll_merge_agg_double("latency").alias("latency"))
    rate = lambda part, whole: F.round(F.try_divide(part, whole), 6)
    return sums.select(
        "period", "searches", rate(F.col("found"), F.col("searches")).alias("success_rate"), rate(F.col("cached"), F.col("searches")).alias("cache_rate"),
        rate(F.col("likes"), F.col("likes") + F.col("dislikes")).alias("like_rate"), rate(F.col("requeries"), F.col("searches")).alias("requery_rate"),
        F.kll_sketch_get_quantile_double("latency", F.lit(0.95)).alias("p95_ms"),
    )


def missed(periods: DataFrame, stage: str = "P0") -> DataFrame:
    """period, kpi, value, target, grave: what missed its target; grave if it did in the period before, too.  A rate of nothing misses none."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kpi"), F.col(k).cast("double").alias("value"), F.lit(t).alias("target")) for k, t in TARGETS[stage].items()])
    rows = periods.select("period", F.explode(pairs).alias("x")).select("period", "x.*")
    bad = F.when(F.col("kpi").isin(*CEILINGS), F.col("value") > F.col("target")).otherwise(F.col("value") < F.col("target"))
    before = F.lag(F.coalesce(bad, F.lit(False))).over(Window.partitionBy("kpi").orderBy("period"))  # a row a period
    return rows.withColumn("_bad", bad).withColumn("grave", F.coalesce(before, F.lit(False))).filter("_bad").drop("_bad")


def daily_scores(rows: DataFrame) -> DataFrame:
    """R-13: a row a day of similarities (ts, score): number, sum, range and sketch."""
    score = F.col("score").cast("double")
    return rows.groupBy(_day(F.col("ts")).alias("day")).agg(F.count("*").alias("n"), F.sum(score).alias("total"), F.min(score).alias("low"), F.max(score).alias("high"), F.kll_sketch_agg_double(score, K).alias("sketch"))


def drift(days: DataFrame) -> DataFrame:
    """R-13: week, number, mean, range and 10th, 50th and 90th percentile of the similarities."""
    sums = days.groupBy(F.date_format(F.date_trunc("week", "day"), "yyyy-MM-dd").alias("week")).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("sketch").alias("sketch"))
    at = {name: F.kll_sketch_get_quantile_double("sketch", F.lit(q)) for name, q in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9))}
    return sums.select("week", "n", F.round(F.col("total") / F.col("n"), 4).alias("mean"), F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), *(c.alias(n) for n, c in at.items()))


def distribution(rows: DataFrame) -> DataFrame:
    """R-13 exactly: week, number, mean, range and 10th, 50th and 90th percentile of similarities (ts, score) to three digits.

    Equal scores are counted before the percentiles, so that a week takes no more memory than there are different scores.
    """
    week, score = F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("week"), F.round("score", 3).alias("score")
    counts = rows.groupBy(week, score).agg(F.count("*").alias("n"), F.sum(F.col("score").cast("double")).alias("total"), F.min("score").alias("low"), F.max("score").alias("high"))
    at = F.percentile("score", F.array(*map(F.lit, (0.1, 0.5, 0.9))), F.col("n"))
    weeks = counts.groupBy("week").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"), at.alias("at"))
    number = lambda c: F.round(c, 4)
    return weeks.select("week", "n", number(F.col("total") / F.col("n")).alias("mean"), number("low").alias("low"), number("high").alias("high"), *(number(F.col("at")[i]).alias(p) for i, p in enumerate(("p10", "p50", "p90"))))


def within_rank(value: Column, quantile: Column, rank: float, error: float = 0.01) -> Column:
    """An aggregate: whether a quantile's rank among the values is the asked one, up to the error."""
    below, up_to = F.avg((value < quantile).cast("double")), F.avg((value <= quantile).cast("double"))
    return (below <= rank + error) & (up_to >= rank - error)
