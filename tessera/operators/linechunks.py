"""Line-addressed chunkers in DataFrame operations (C-02 with its overflow, C-04, C-05).

The chunkers of ``chunking`` walk a document from cut to cut.  Where the next cut is depends on the last one alone, so it is
looked up for every line at once: prefix sums of characters and tokens are running sums over a document's lines, and "the
first line at which the sum reaches a value" is a running minimum over sums and values sorted together.  Then the cuts are
followed from the first line of each document, and contents are sliced.  All lines of a document meet in a task, as
a document is a row of the input; nothing larger does.

Results equal the Python chunkers' with the additive token estimate and without merging of small chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.chunking import BOUNDARIES, Limits

#: What Python's strip takes off a line.
_WHITE = "[\\s\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def lines_of(docs: DataFrame) -> DataFrame:
    """id, line (from 0), text, and before this line the document's characters with their line ends, and tokens line by line."""
    rows = docs.select("id", F.posexplode(F.split(F.coalesce("content", F.lit("")), "\n", -1)).alias("line", "text"))
    so_far = Window.partitionBy("id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    chars, tokens = (F.char_length("text") + 1).cast("bigint"), F.ceil(F.char_length("text") / 4)
    return rows.select("*", (F.sum(chars).over(so_far) - chars).alias("chars"), (F.sum(tokens).over(so_far) - tokens).alias("tokens"), chars.alias("_c"), tokens.alias("_t"))


def _first_reaching(points: DataFrame, asked: DataFrame, name: str) -> DataFrame:
    """asked (id, line, value) with ``name``: the least line of points (id, line, value; both grow together) whose value is the asked one or more."""
    both = points.select("id", "line", "value", F.lit(0).alias("asks")).unionAll(asked.select("id", "line", "value", F.lit(1)))
    seen = Window.partitionBy("id").orderBy(F.desc("value"), "asks").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(name, F.min(F.when(F.col("asks") == 0, F.col("line"))).over(seen)).filter("asks = 1").select("id", "line", name)


def _last_within(points: DataFrame, asked: DataFrame, name: str) -> DataFrame:
    """The same for the greatest line whose value is the asked one or less."""
    both = points.select("id", "line", "value", F.lit(0).alias("asks")).unionAll(asked.select("id", "line", "value", F.lit(1)))
    seen = Window.partitionBy("id").orderBy("value", "asks").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(name, F.max(F.when(F.col("asks") == 0, F.col("line"))).over(seen)).filter("asks = 1").select("id", "line", name)


def _marks(lines: DataFrame, how: str) -> DataFrame:
    """id, line, unit (it begins one) and may_cut (an overlong chunk may end after it)."""
    if how == "source":
        begins = F.col("text").rlike(BOUNDARIES[0]) | F.col("text").rlike(BOUNDARIES[1])
        return lines.select("id", "line", begins.alias("unit"), F.lit(True).alias("may_cut"))
    so_far = Window.partitionBy("id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    bare, bar = F.regexp_replace("text", f"^{_WHITE}+|{_WHITE}+$", ""), F.col("text").contains("|")
    rows = lines.select("id", "line", bare.alias("bare"), bar.alias("bar"))
    rows = rows.withColumn("fenced", F.sum(F.col("bare").startswith("```").cast("int")).over(so_far) % 2 == 1)
    begun = F.when(F.col("bare").startswith("|") | (F.col("bar") & ~F.col("fenced")), True).when(~F.col("bar"), False)
    rows = rows.withColumn("table", F.coalesce(F.last(begun, ignorenulls=True).over(so_far), F.lit(False)))
    free = ~F.col("fenced") & ~F.col("table")
    return rows.select("id", "line", (free & F.col("bare").startswith("#")).alias("unit"), free.alias("may_cut"))


def _plain_cuts(lines: DataFrame, limits: Limits) -> DataFrame:
    """id, line, end: the end of a chunk that begins at the line; carried: where the next one begins after a chunk that ends with the line."""
    ends = lines.select("id", (F.col("line") + 1).alias("line"), (F.col("chars") + F.col("_c")).alias("chars"), (F.col("tokens") + F.col("_t")).alias("tokens"))
    full = _first_reaching(ends.withColumn("value", F.col("chars")), lines.withColumn("value", F.col("chars") + 4 * limits.target - 2), "end")
    back = _last_within(lines.withColumn("value", F.col("tokens")), ends.withColumn("value", F.col("tokens") - limits.overlap), "carried")
    return full.join(back.select("id", (F.col("line") - 1).alias("line"), F.when(F.col("carried").isNotNull(), F.least("carried", F.col("line") - 1)).alias("carried")), ["id", "line"], "left")


def _unit_cuts(lines: DataFrame, limits: Limits, how: str) -> DataFrame:
    """id, line, end: a chunk of a unit ends where the next one begins, or is overlong and ends before the carried lines."""
    marks = _marks(lines, how)
    ends = lines.select("id", (F.col("line") + 1).alias("line"), (F.col("chars") + F.col("_c")).alias("chars"), (F.col("tokens") + F.col("_t")).alias("tokens"))
    units = _first_reaching(marks.filter("unit").withColumn("value", F.col("line").cast("bigint")), lines.withColumn("value", (F.col("line") + 1).cast("bigint")), "unit")
    long = _first_reaching(ends.withColumn("value", F.col("chars")), lines.withColumn("value", F.col("chars") + 4 * limits.most + 2), "long")
    # what is carried over must leave a line: the tokens after the first one are ``overlap`` at least
    leave = _first_reaching(ends.withColumn("value", F.col("tokens")), lines.withColumn("value", F.col("tokens") + F.col("_t") + limits.overlap), "leave")
    over = long.join(leave, ["id", "line"]).select("id", "line", F.greatest("long", "leave").alias("from"), (F.col("long").isNotNull() & F.col("leave").isNotNull()).alias("_both"))
    free = marks.filter("may_cut").select("id", (F.col("line") + 1).alias("line")).withColumn("value", F.col("line").cast("bigint"))
    cut = _first_reaching(free, over.filter("_both").withColumn("value", F.col("from").cast("bigint")), "at")
    back = _last_within(lines.withColumn("value", F.col("tokens")), ends.withColumn("value", F.col("tokens") - limits.overlap), "end")
    back = back.select("id", F.col("line").alias("at"), F.least("end", F.col("line") - 1).alias("end"))
    rows = units.join(cut, ["id", "line"], "left").join(back, ["id", "at"], "left")
    first = F.when(F.col("unit").isNotNull() & (F.col("at").isNull() | (F.col("unit") < F.col("at"))), F.col("unit")).otherwise(F.col("end"))
    return rows.select("id", "line", first.alias("end"), F.lit(None).cast("int").alias("carried"))


def chunks(docs: DataFrame, how: str = "plain", limits: Limits = Limits()) -> DataFrame:
    """id, ordinal, start_line, end_line (from 1), content and token_count of texts (id, content), chunked as ``plain``, ``markdown`` or ``source``.

    ids are distinct; a null text is an empty one, and gives a chunk only if ``least`` is 0.
    """
    if limits.merge_small or limits.overlap < 1:
        raise ValueError("small chunks aren't merged here, and something must be carried over")
    lines = lines_of(docs)
    cuts = _plain_cuts(lines, limits) if how == "plain" else _unit_cuts(lines, limits, how)
    row = F.struct(F.col("line"), F.col("end"), F.col("carried"))
    listed = cuts.groupBy("id").agg(F.sort_array(F.collect_list(row)).alias("cuts"))  # a document's lines

    def follow(state: Column, _: Column) -> Column:
        """One chunk on; a plain one ends behind the one before it, whatever it carries over."""
        n, at = F.size("cuts"), state["at"]
        end = F.get("cuts", at)["end"]
        after = end
        if how == "plain":
            end = F.when(end.isNotNull(), F.greatest(end, state["last"] + 1))
            carried = F.get("cuts", end - 1)["carried"]
            after = F.when(carried > at, carried).otherwise(end)
        ends = end.isNotNull() & (end <= n)  # what is left of a document is its last chunk
        found = F.concat(state["found"], F.array(F.struct(at.alias("line"), F.when(ends, end).otherwise(n).alias("end"))))
        return F.when(at < n, F.struct(F.when(ends, after).otherwise(n).alias("at"), F.when(ends, end).otherwise(n).alias("last"), found.alias("found"))).otherwise(state)

    begin = F.expr("named_struct('at', 0, 'last', 0, 'found', cast(array() as array<struct<line:int,end:int>>))")
    ranges = listed.select("id", F.aggregate(F.sequence(F.lit(1), F.size("cuts")), begin, follow, lambda s: s["found"]).alias("found"))
    text = F.array(F.split(F.coalesce("content", F.lit("")), "\n", -1))
    sliced = lambda parts: F.transform("found", lambda r: F.struct(r["line"].alias("line"), r["end"].alias("end"), F.array_join(F.slice(parts, r["line"] + 1, r["end"] - r["line"]), "\n").alias("content")))
    # a lambda's argument is evaluated once: a text is split once for all its chunks
    rows = docs.select("id", "content").join(ranges, "id").select("id", F.explode(F.transform(text, sliced)[0]).alias("c"))
    rows = rows.select("id", "c.*").withColumn("token_count", F.ceil(F.char_length("content") / 4).cast("int")).filter(F.col("token_count") >= limits.least)
    number = F.row_number().over(Window.partitionBy("id").orderBy("line")) - 1
    return rows.select("id", number.alias("ordinal"), (F.col("line") + 1).alias("start_line"), F.col("end").alias("end_line"), "content", "token_count")
