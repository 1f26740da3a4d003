"""Chat formatting with tool-call linking.  DataFrame functions only.

A message whose text is a JSON object may carry tool calls or a tool's result:

* assistant: ``{"content": ..., "tool_calls": [{"id": ..., "name": ..., "arguments": {...}}, ...]}``; arguments
  may also be a string that holds an object; an argument ``"$<id>"`` uses the result of another call;
* tool: ``{"tool_call_id": ..., "content": ...}``.

Any other text is content as it stands.  Calls and results are hash-joined on (conversation, id).  Messages get
a topological order: a message's place is (``order_turn``, ``order_level``, ``turn``), and a result comes after
the message with its call, a message after the results that its calls use, whatever their turns say.  Where the turns of a
conversation say the same, they are the order, and no round is needed; only the other conversations' messages are
settled in rounds, as many as their longest chain.  Arguments are checked against schemas;
each message becomes one line of canonical JSON (keys in order at every depth, no white space).

``link`` is null for plain messages; ``linked`` where call and result meet; else the first that holds of
``cyclic`` (a message that waits, over others, for its own result, or for such a message's), ``duplicate`` (a call whose id
an earlier one has), ``no_result``, ``orphan`` (a result without a call).

Defined results: a null text gives ``"content":null``; a null role ``"role":null``; null conversations or ids
link with nothing; messages of equal conversation and turn are one in the order; repeated rows give a line each; a very
long text is a value like others, and no conversation has to fit a task; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import delete_on_exit, discard, materialise, shared_dir

#: Tool -> argument -> (JSON type, whether it must be there).
Schemas = Mapping[str, Mapping[str, tuple[str, bool]]]
TYPES = ("string", "integer", "number", "boolean", "object", "array")


def _schema_map(schemas: Schemas) -> Column:
    """map<tool, map<argument, 'type' or 'type!'>>; '!' marks what must be there."""
    tools = [x for tool in sorted(schemas) for x in (F.lit(tool), _arguments(schemas[tool]))]
    return F.create_map(*tools) if tools else F.create_map(F.lit(""), F.create_map(F.lit(""), F.lit("")))


def _arguments(arguments: Mapping[str, tuple[str, bool]]) -> Column:
    for kind, _ in arguments.values():
        if kind not in TYPES:
            raise ValueError(f"unknown JSON type {kind!r}")
    pairs = [F.lit(x) for name in sorted(arguments) for x in (name, arguments[name][0] + "!" * arguments[name][1])]
    return F.create_map(*pairs) if pairs else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))


def _is(kind: Column, wanted: Column) -> Column:
    """Whether Spark's name of a variant's type is the JSON type."""
    integer, number = kind == "BIGINT", kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    return (
        F.when(wanted == "string", kind == "STRING")
        .when(wanted == "integer", integer)
        .when(wanted == "number", number)
        .when(wanted == "boolean", kind == "BOOLEAN")
        .when(wanted == "object", kind.startswith("OBJECT"))
        .otherwise(kind.startswith("ARRAY"))
    )


def _call_errors(call: Column, schemas: Column) -> Column:
    """Messages about a call's arguments."""
    given, wanted = call["arguments"], F.try_element_at(schemas, call["name"])
    known = F.filter(
        F.transform(
            F.map_entries(wanted),
            lambda e: F.when(
                ~F.map_contains_key(given, e["key"]), F.when(e["value"].endswith("!"), F.concat(F.lit("missing "), e["key"]))
            ).when(~_is(F.schema_of_variant(F.try_element_at(given, e["key"])), F.rtrim(e["value"], F.lit("!"))), F.concat(F.lit("type of "), e["key"])),
        ),
        lambda x: x.isNotNull(),
    )
    extra = F.transform(F.array_except(F.map_keys(given), F.map_keys(wanted)), lambda k: F.concat(F.lit("unknown "), k))
    found = F.when(wanted.isNull(), F.array(F.lit("unknown tool"))).when(given.isNull(), F.array(F.lit("arguments are no object"))).otherwise(F.array_sort(F.concat(known, extra)))
    return F.transform(found, lambda m: F.concat(F.coalesce(call["id"], F.lit("?")), F.lit(": "), m))


def _parsed(conversations: DataFrame) -> DataFrame:
    """turn rows with ``calls`` (id, name, arguments, uses), ``result_of`` and the canonical parts."""
    rows = conversations.select(F.col("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    body = F.when(F.col("text").rlike(r"^\s*\{") & F.col("role").isin("assistant", "tool"), F.try_parse_json("text"))
    rows = rows.withColumn("body", body)
    listed = F.try_variant_get("body", "$.tool_calls", "array<variant>")
    raw = lambda v: F.try_variant_get(v, "$.arguments", "string")

    def call(v: Column) -> Column:
        arguments = F.try_variant_get(F.try_parse_json(raw(v)), "$", "map<string,variant>")
        uses = F.array_distinct(F.regexp_extract_all(F.coalesce(raw(v), F.lit("")), F.lit(r'"\$([^"\\]+)"'), 1))
        return F.struct(
            F.try_variant_get(v, "$.id", "string").alias("id"), F.try_variant_get(v, "$.name", "string").alias("name"), arguments.alias("arguments"), uses.alias("uses"),
            F.to_json(F.try_parse_json(raw(v))).alias("canonical"), raw(v).alias("raw"),
        )

    rows = rows.withColumn("calls", F.when(F.col("role") == "assistant", F.transform(listed, call)))
    return rows.withColumn("result_of", F.when(F.col("role") == "tool", F.try_variant_get("body", "$.tool_call_id", "string")))


def _quoted(text: Column) -> Column:
    """A JSON string, or null."""
    return F.coalesce(F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1), F.lit("null"))


def _json(name: str, value: Column) -> Column:
    return F.concat(F.lit(f'"{name}":'), value)


def _line(rows: DataFrame) -> Column:
    """The message as canonical JSON; keys stand in order."""
    structured = F.col("calls").isNotNull() | F.col("result_of").isNotNull()
    text = F.when(F.col("text").isNull(), F.lit("null")).otherwise(_quoted(F.col("text")))
    inner = F.coalesce(F.to_json(F.try_variant_get("body", "$.content", "variant")), F.lit("null"))
    role = F.when(F.col("role").isNull(), F.lit("null")).otherwise(_quoted(F.col("role")))
    one = lambda c: F.concat(
        F.lit("{"), F.concat_ws(",", _json("arguments", F.coalesce(c["canonical"], F.when(c["raw"].isNotNull(), _quoted(c["raw"])), F.lit("null"))), _json("id", F.when(c["id"].isNull(), F.lit("null")).otherwise(_quoted(c["id"]))), _json("name", F.when(c["name"].isNull(), F.lit("null")).otherwise(_quoted(c["name"])))), F.lit("}"),
    )
    calls = F.when(F.col("calls").isNotNull(), _json("tool_calls", F.concat(F.lit("["), F.array_join(F.transform("calls", one), ","), F.lit("]"))))
    result = F.when(F.col("result_of").isNotNull(), _json("tool_call_id", _quoted(F.col("result_of"))))
    return F.concat(F.lit("{"), F.concat_ws(",", _json("content", F.when(structured, inner).otherwise(text)), _json("role", role), result, calls), F.lit("}"))


def _joined(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A hash join; ``b`` has one row a key, so that no key is hot on the side that is held."""
    return a.join(b.hint("shuffle_hash"), on, how)


def _after(turn: Column, at: Column, level: Column) -> Column:
    """The place of a message of this turn that must come after (at, level)."""
    behind = at >= turn
    return F.struct(F.when(behind, at).otherwise(turn).alias("at"), F.when(behind, level + 1).otherwise(0).alias("level"))


def _places(messages: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, turn, place): each message with calls after all results it uses; place is null on and behind a cycle.

    messages: conv_id, turn.  edges: conv_id, turn, need (the turn of a call whose result is used), answered (the result's turn, or null).
    """
    # Where every result stands before the message that uses it, turns are the order.
    against = edges.filter(F.greatest("need", "answered") >= F.col("turn")).select("conv_id").distinct()
    here = F.struct(F.col("turn").alias("at"), F.lit(0).alias("level")).alias("place")
    edges = materialise(_joined(edges, against, ["conv_id"], "left_semi"), compact=True)
    if edges.isEmpty():
        discard(edges)
        return messages.select("conv_id", "turn", here)
    waits = edges.groupBy("conv_id", "turn").agg(F.count("*").alias("open"))
    some = _joined(messages, against, ["conv_id"], "left_semi")
    state = materialise(_joined(some, waits, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("open", F.lit(0)).alias("open"), here), compact=True)
    path = shared_dir(messages.sparkSession)
    while True:
        state.filter("open = 0").select("conv_id", "turn", "place").write.mode("append").parquet(path)
        met = _joined(edges, state.filter("open = 0").select("conv_id", F.col("turn").alias("need"), "place"), ["conv_id", "need"])
        answer = _after(F.coalesce("answered", "need"), F.col("place.at"), F.col("place.level"))
        behind = met.select("conv_id", "turn", answer.alias("answer")).groupBy("conv_id", "turn").agg(F.count("*").alias("met"), F.max("answer").alias("answer"))
        waiting = _joined(state.filter("open > 0"), behind, ["conv_id", "turn"], "left")
        later = F.when(F.col("answer").isNull(), F.col("place")).otherwise(F.greatest("place", F.struct(F.col("answer.at").alias("at"), (F.col("answer.level") + 1).alias("level"))))
        after = materialise(waiting.select("conv_id", "turn", (F.col("open") - F.coalesce("met", F.lit(0))).alias("open"), later.alias("place")), compact=True)
        discard(state)
        state = after
        if state.filter("open = 0").isEmpty():
            break
    delete_on_exit(messages.sparkSession, path)
    settled = messages.sparkSession.read.schema(state.drop("open").schema).parquet(path)
    rest = state.select("conv_id", "turn", F.lit(None).cast(state.schema["place"].dataType).alias("place"))
    discard(edges)
    return _joined(messages, against, ["conv_id"], "left_anti").select("conv_id", "turn", here).unionAll(settled).unionAll(rest)


def format_chat(conversations: DataFrame, schemas: Schemas) -> DataFrame:
    """conv_id, turn, role, order_turn, order_level, link, tool_errors, message: one row a message."""
    rows = _parsed(conversations).withColumn("errors", F.flatten(F.transform("calls", lambda c: _call_errors(c, _schema_map(schemas)))))
    rows = rows.withColumn("line", _line(rows))
    each = rows.filter("size(calls) > 0 and conv_id is not null and turn is not null").select("conv_id", "turn", F.explode("calls").alias("call"))
    # One row an id, however many calls repeat it: the earliest, so that no join multiplies rows.
    named = each.filter("call.id is not null").groupBy("conv_id", F.col("call.id").alias("id"))
    calls = named.agg(F.min("turn").alias("need"))
    results = rows.filter("result_of is not null and conv_id is not null").groupBy("conv_id", F.col("result_of").alias("id")).agg(F.min("turn").alias("answered"))
    calls = materialise(_joined(calls, results, ["conv_id", "id"], "left"))
    messages = materialise(each.select("conv_id", "turn").distinct())
    uses = each.select("conv_id", "turn", F.explode("call.uses").alias("id")).distinct()
    edges = materialise(_joined(uses, calls, ["conv_id", "id"]).select("conv_id", "turn", "need", "answered").distinct())
    places = materialise(_places(messages, edges))

    owner = each.filter("call.id is not null").groupBy("conv_id", "turn", F.col("call.id").alias("id")).agg(F.count("*").alias("here"))
    owner = _joined(owner, calls, ["conv_id", "id"])
    verdict = (
        F.when(F.count_if((F.col("need") < F.col("turn")) | (F.col("here") > 1)) > 0, "duplicate")
        .when(F.count_if(F.col("answered").isNull()) > 0, "no_result")
        .otherwise("linked")
    )
    verdicts = owner.groupBy("conv_id", "turn").agg(verdict.alias("verdict"))
    looped = F.col("place").isNull()
    callers = _joined(places, verdicts, ["conv_id", "turn"], "left").select("conv_id", "turn", F.lit(True).alias("calls_known"), "place", F.when(looped, "cyclic").otherwise(F.coalesce("verdict", F.lit("no_result"))).alias("call_link"))
    answers = _joined(calls.select("conv_id", F.col("id").alias("result_of"), F.col("need").alias("turn")), places, ["conv_id", "turn"])
    answers = answers.select("conv_id", "result_of", F.col("turn").alias("call_turn"), F.col("place").alias("call_place"))
    structured = rows.filter("size(calls) > 0 or result_of is not null")
    structured = _joined(_joined(structured, callers, ["conv_id", "turn"], "left"), answers, ["conv_id", "result_of"], "left")
    is_result, here = F.col("result_of").isNotNull(), F.struct(F.col("turn").alias("at"), F.lit(0).alias("level"))
    answer = F.when(F.col("call_turn").isNull(), here).otherwise(_after(F.col("turn"), F.coalesce("call_place.at", "call_turn"), F.coalesce("call_place.level", F.lit(0))))
    place = F.when(is_result, answer).otherwise(F.coalesce("place", here))
    link = F.when(is_result, F.when(F.col("call_turn").isNull(), "orphan").when(F.col("call_place").isNull(), "cyclic").otherwise("linked")).otherwise(F.coalesce("call_link", F.lit("no_result")))
    structured = structured.withColumn("where", place).select(
        "conv_id", "turn", "role", F.col("where.at").alias("order_turn"), F.col("where.level").cast("int").alias("order_level"), link.alias("link"), F.array_join("errors", "; ").alias("tool_errors"), F.col("line").alias("message")
    )
    plain = rows.filter("not coalesce(size(calls) > 0, false) and result_of is null").select(
        "conv_id", "turn", "role", F.col("turn").alias("order_turn"), F.lit(0).alias("order_level"), F.lit(None).cast("string").alias("link"), F.lit(None).cast("string").alias("tool_errors"), F.col("line").alias("message")
    )
    discard(messages, edges)
    return plain.unionAll(structured)
