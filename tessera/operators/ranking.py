"""Keyword scores, fusion, re-ranking and retrieval quality (R-01 to R-16)."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import INTENT_WEIGHTS
from tessera.operators.lineage import cut

#: Weights of the final score.
FINAL_WEIGHTS = {"hybrid": 0.5, "keyword": 0.2, "importance": 0.15, "freshness": 0.1, "path": 0.05}
#: Stages of the cascade.
COARSE, FINE, FINAL = 200, 20, 10
WEEKLY_NOTES = 5
#: A severity's priority.
PRIORITIES = {"critical": "P1", "high": "P2", "medium": "P3", "low": "P3"}


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def _count(found: Column, term: str) -> Column:
    return F.size(F.filter(found, lambda x: x == term))


def bm25(docs: DataFrame, query: Sequence[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """R-02: id and keyword score of the documents (id, text) that hold a query term.

    Each text is cut into terms once; only its length and the counts of the query's terms leave the scan, and the
    statistics and the scores are taken from these.
    """
    wanted = sorted({t.lower() for t in query})
    counts = lambda t: F.struct(F.size(t).alias("len"), *(_count(t, w).alias(f"tf{i}") for i, w in enumerate(wanted)))
    # a lambda's argument is evaluated once, a projected column once for each use
    rows = cut(docs.select("id", F.transform(F.array(terms(F.col("text"))), counts)[0].alias("c")).select("id", "c.*"))
    stats = rows.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted)))).first()
    score, any_ = F.lit(0.0), F.lit(False)
    for i in range(len(wanted)):
        n, df, tf = stats["n"], stats[f"df{i}"], F.col(f"tf{i}")
        idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.lit(stats["avg_len"] or 1.0)))
        any_ = any_ | (tf > 0)
    return rows.filter(any_).select("id", F.round(score, 6).alias("keyword"))


def min_max(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """R-03: columns scaled to 0..1 over all rows; a column with one value gives 0, NULL stays."""
    ends = df.agg(*(f(c).alias(f"_{n}_{c}") for c in columns for f, n in ((F.min, "lo"), (F.max, "hi"))))
    scaled = {c: F.when(F.col(c).isNotNull(), F.coalesce(F.try_divide(F.col(c) - F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}")), F.lit(0.0))) for c in columns}
    return df.join(F.broadcast(ends)).select(*(scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns))


def fuse(vector_hits: DataFrame, keyword_hits: DataFrame, intent: str = "default") -> DataFrame:
    """R-03: id and the weighted sum of the normalised scores; a side that lacks a row counts 0."""
    v, k = INTENT_WEIGHTS[intent]
    both = min_max(vector_hits, ["score"]).join(min_max(keyword_hits, ["keyword"]), "id", "full_outer")
    return both.select("id", F.round(v * F.coalesce("score", F.lit(0.0)) + k * F.coalesce("keyword", F.lit(0.0)), 6).alias("hybrid"))


def exclude(rows: DataFrame) -> DataFrame:
    """R-01: rows that must not be found: to be fixed, excluded, or with a secret."""
    return rows.filter(~F.coalesce(F.col("ingest_status").isin("needs_fix", "excluded"), F.lit(False)) & ~F.coalesce(F.col("secret_scan") == "detected", F.lit(False)))


def adjusted(score: Column, stale: Column, quality: Column, errors: Column) -> Column:
    """R-06: stale times 0.7, quality over 0.8 times 1.2 or under 0.3 times 0.7, each validation error times 0.9."""
    out = score * F.when(stale, 0.7).otherwise(1.0)
    out = out * F.when(quality > 0.8, 1.2).when(quality < 0.3, 0.7).otherwise(1.0)
    return out * F.pow(F.lit(0.9), F.coalesce(errors, F.lit(0)))


def final_score(parts: Mapping[str, Column], weights: Mapping[str, float] = FINAL_WEIGHTS) -> Column:
    """R-05: the weighted sum of the parts; one that is missing counts 0."""
    out = F.lit(0.0)
    for name, w in weights.items():
        out = out + F.coalesce(parts[name], F.lit(0.0)) * w
    return out


def cascade(rows: DataFrame, coarse: Column, fine: Column, final: Column, sizes: Sequence[int] = (COARSE, FINE, FINAL)) -> DataFrame:
    """R-04: three top-k stages, each over what the one before left."""
    for stage, (score, n) in enumerate(zip((coarse, fine, final), sizes)):
        rows = rows.withColumn(f"stage{stage + 1}", score).orderBy(F.desc_nulls_last(f"stage{stage + 1}"), "id").limit(n)
    return rows


def merge_rewrites(*hits: DataFrame) -> DataFrame:
    """R-08: hits (id, score) of several forms of a query, each id with its best score."""
    out = hits[0]
    for h in hits[1:]:
        out = out.unionByName(h)
    return out.groupBy("id").agg(F.max("score").alias("score"))


def expand_terms(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """R-08: query_id and its terms with their synonyms (term, synonym)."""
    rows = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("query")))).alias("term"))
    more = rows.join(synonyms, "term").select("query_id", F.col("synonym").alias("term"))
    return rows.unionAll(more).distinct()


def expand_family(hits: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """R-09: each hit with its parents, and its first children by ordinal, ``most`` at most."""
    up = hits.join(edges, hits["id"] == edges["child"]).select("id", F.lit("parent").alias("kind"), F.col("parent").alias("other"))
    order = Window.partitionBy("id").orderBy("ordinal", "child")
    down = hits.join(edges, hits["id"] == edges["parent"]).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most)
    return up.unionAll(down.select("id", F.lit("child"), F.col("child")))


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """R-10: Precision@5, Recall@20, nDCG@10 and mean rank of the relevant (ACR), by query.

    ranked: query_id, rank, id; relevant: query_id, id.
    """
    rel = relevant.select("query_id", "id").distinct()
    wanted = rel.groupBy("query_id").agg(F.count("*").alias("wanted"))
    rows = ranked.join(rel.withColumn("_hit", F.lit(1)), ["query_id", "id"], "left").withColumn("hit", F.coalesce("_hit", F.lit(0)))
    return graded(rows, wanted)


def graded(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """R-10 from ranked rows (query_id, rank, hit 0 or 1) and the numbers of relevant ones (query_id, wanted)."""
    gain = F.sum(F.when(F.col("rank") <= 10, F.col("hit") / F.log2(F.col("rank") + 1.0)).otherwise(0.0))
    per = rows.groupBy("query_id").agg(
        (F.sum(F.when(F.col("rank") <= 5, F.col("hit")).otherwise(0)) / 5).alias("p5"), F.sum(F.when(F.col("rank") <= 20, F.col("hit")).otherwise(0)).alias("found"), gain.alias("dcg"), F.avg(F.when(F.col("hit") == 1, F.col("rank"))).alias("acr")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("wanted"), F.lit(10)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return per.join(wanted, "query_id").select(
        "query_id", F.round("p5", 6).alias("precision_5"), F.round(F.col("found") / F.col("wanted"), 6).alias("recall_20"), F.round(F.col("dcg") / ideal, 6).alias("ndcg_10"), F.round("acr", 6).alias("acr")
    )


def regressions(before: DataFrame, after: DataFrame, most: float = 0.05) -> DataFrame:
    """R-11: metrics (metric, value) that fell by more than ``most`` of their value."""
    rows = before.select("metric", F.col("value").alias("old")).join(after.select("metric", F.col("value").alias("new")), "metric")
    drop = F.try_divide(F.col("old") - F.col("new"), F.col("old"))
    return rows.withColumn("drop", F.round(drop, 6)).filter(F.col("drop") > most)


def priority(severity: Column) -> Column:
    out = F.lit("P3")
    for s, p in PRIORITIES.items():
        out = F.when(severity == s, p).otherwise(out)
    return out


def backlog(notes: DataFrame, most: int = WEEKLY_NOTES) -> DataFrame:
    """R-14: note_id, week, priority and status of notes (note_id, severity, ts): the gravest of each week are open, the rest noop."""
    grade = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "high", 1).when(F.col("severity") == "medium", 2).otherwise(3)
    week = F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd")
    order = Window.partitionBy("week").orderBy("_grade", "note_id")
    rows = notes.withColumn("week", week).withColumn("_grade", grade).withColumn("_n", F.row_number().over(order))
    return rows.select("note_id", "week", priority(F.col("severity")).alias("priority"), F.when(F.col("_n") <= most, "open").otherwise("noop").alias("status"))


def quality_metrics(notes: DataFrame, as_of: str) -> DataFrame:
    """R-15: by severity the notes, the resolved ones, and the days since the last."""
    return notes.groupBy("severity").agg(F.count("*").alias("notes"), F.count_if("resolved").alias("resolved"), F.datediff(F.lit(as_of).cast("date"), F.max("ts").cast("date")).alias("days_since_last"))
