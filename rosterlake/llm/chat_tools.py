"""Chat formatting: tool calls and results linked by identifier, ordered by their dependencies, checked and serialised.

Calls and results meet in a shuffled hash join on (conversation, call id), a key that spreads a conversation of any length.
Order: calls whose dependencies all stand earlier keep their place, which already is a topological order; only calls that
depend on a later one, and what depends on them, are ordered by Kahn's algorithm: a conversation of up to GROUP_EDGES
dependencies in one task, a larger one by rounds over joins. Positions are ranks from a range sort over the cluster, so no
conversation has to fit into one task.
"""

from __future__ import annotations

import json
import math
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, running_totals, saved, text_batches


GROUP_EDGES = 100_000  # dependencies of a conversation that one task orders


def _is(value, kind: str) -> bool:
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    return {
        "string": isinstance(value, str), "boolean": isinstance(value, bool), "null": value is None, "object": isinstance(value, dict),
        "array": isinstance(value, list), "number": number, "integer": number and (isinstance(value, int) or value.is_integer()),
    }.get(kind, False)


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """Where value breaks a JSON schema (type, enum, required, properties, additionalProperties, items, bounds)."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not one of the values allowed")
    if isinstance(value, str):
        out += [f"{at}: too short"] * (len(value) < schema.get("minLength", 0)) + [f"{at}: too long"] * (len(value) > schema.get("maxLength", float("inf")))
    if _is(value, "number"):
        out += [f"{at}: too small"] * (value < schema.get("minimum", float("-inf"))) + [f"{at}: too large"] * (value > schema.get("maximum", float("inf")))
    if isinstance(value, list) and "items" in schema:
        out += [e for i, x in enumerate(value) for e in violations(x, schema["items"], f"{at}[{i}]")]
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        out += [e for k in sorted(value) if k in known for e in violations(value[k], known[k], f"{at}.{k}")]
        if schema.get("additionalProperties") is False:
            out += [f"{at}.{k}: not known" for k in sorted(value) if k not in known]
    return out


def _storable(text: str) -> str:
    """text with lone surrogates, which UTF-8 cannot hold, as the escapes that JSON has for them."""
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value) -> str:
    """JSON with sorted keys, no blanks, and characters as they are, but for lone surrogates."""
    return _storable(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _finite(text: str) -> float:
    value = float(text)
    if not math.isfinite(value):
        raise ValueError(f"{text} is out of range")
    return value


def parse_arguments(text: str | None):
    """The JSON value of a call's arguments; ValueError or TypeError for what is none, for NaN, Infinity and floats beyond a double's range."""
    return json.loads(text, parse_constant=_finite, parse_float=_finite)


def _levels_of(edges: list[tuple[str, str, bool]]) -> dict[str, int | None]:
    """Levels of the calls of one conversation that depend, at whatever distance, on a later one; edges are (call, dependency, late)."""
    users: dict[str, list[str]] = {}
    for call, dep, _ in edges:
        users.setdefault(dep, []).append(call)
    late = {call for call, _, is_late in edges if is_late}
    todo = list(late)
    while todo:
        more = [u for u in users.get(todo.pop(), ()) if u not in late]
        late.update(more)
        todo += more
    open_deps = dict.fromkeys(late, 0)
    for call, dep, _ in edges:
        if dep in late:
            open_deps[call] += 1
    level: dict[str, int | None] = dict.fromkeys(late)
    ready = deque(c for c, n in open_deps.items() if not n)
    level.update(dict.fromkeys(ready, 1))
    while ready:
        call = ready.popleft()
        for user in users.get(call, ()):
            open_deps[user] -= 1
            if not open_deps[user]:
                level[user] = level[call] + 1  # the last dependency to be placed is the deepest
                ready.append(user)
    return level


def _order_conversations(batches):
    """Levels for rows (conv, call_id, dep, late) that come sorted by conv; a conversation may reach over batches."""
    def done(conv: str, edges: list) -> pa.RecordBatch:
        level = _levels_of(edges)
        return pa.RecordBatch.from_arrays([pa.array([conv] * len(level)), pa.array(list(level), pa.string()), pa.array(list(level.values()), pa.int32())], names=["conv", "call_id", "level"])

    conv, edges = None, []
    for batch in batches:
        ready = []
        for own, *edge in zip(*(c.to_pylist() for c in batch.columns)):
            if own != conv and edges:
                ready.append(done(conv, edges))
                edges = []
            conv = own
            edges.append(tuple(edge))
        if ready:
            yield pa.Table.from_batches(ready).combine_chunks().to_batches()[0]
    if edges:
        yield done(conv, edges)


def dependency_levels(calls: DataFrame) -> DataFrame:
    """(conv, call_id, level) from calls(conv, call_id, turn, after): 0 where every dependency stands earlier, null in a cycle.

    The level of a call that depends on a later one, or on such a call, is 1 more than that of the deepest of these it waits
    for. Rounds run only over conversations with more than GROUP_EDGES dependencies.
    """
    edges = calls.select("conv", "call_id", F.explode("after").alias("dep")).distinct()
    own = calls.select("conv", F.col("call_id").alias("dep"), F.struct("turn", "call_id").alias("dep_place"))
    edges = edges.join(own, ["conv", "dep"]).join(calls.select("conv", "call_id", F.struct("turn", "call_id").alias("place")), ["conv", "call_id"])
    edges = saved(edges.select("conv", "call_id", "dep", (F.col("dep_place") >= F.col("place")).alias("late")), "chat-edges")
    convs = saved(edges.groupBy("conv").agg(F.count(F.lit(1)).alias("edges"), F.bool_or("late").alias("late")).filter("late").select("conv", "edges"), "chat-late")
    few = edges.join(convs.filter(F.col("edges") <= GROUP_EDGES), "conv").select("conv", "call_id", "dep", "late")
    sorted_few = few.repartition("conv").sortWithinPartitions("conv")
    marks = sorted_few.mapInArrow(_order_conversations, "conv string, call_id string, level int")
    large = convs.filter(F.col("edges") > GROUP_EDGES)
    if not large.isEmpty():
        marks = marks.unionByName(_levels_by_rounds(edges.join(large.select("conv"), "conv")))
    marks = saved(marks, "chat-levels")
    free = calls.select("conv", "call_id").join(marks, ["conv", "call_id"], "left_anti").withColumn("level", F.lit(0))
    return free.unionByName(marks)


def _levels_by_rounds(edges: DataFrame) -> DataFrame:
    """(conv, call_id, level) as _levels_of, one round of joins for each level."""
    late = saved(edges.filter("late").select("conv", "call_id").distinct(), "chat-late")
    n, links = late.count(), edges.select("conv", "call_id", "dep")
    while True:
        more = links.join(late.withColumnRenamed("call_id", "dep"), ["conv", "dep"]).select("conv", "call_id")
        wider = saved(late.unionByName(more).distinct(), "chat-late")
        discard(late)
        late, before, n = wider, n, wider.count()
        if n == before:
            break
    waiting = late
    inner = saved(links.join(late.withColumnRenamed("call_id", "dep"), ["conv", "dep"]), "chat-inner")
    placed, level = None, 0
    while True:
        open_ = inner.join(waiting.withColumnRenamed("call_id", "dep"), ["conv", "dep"], "left_semi").select("conv", "call_id").distinct()
        level += 1
        ready = saved(waiting.join(open_, ["conv", "call_id"], "left_anti").withColumn("level", F.lit(level)), "chat-ready")
        if ready.isEmpty():
            break
        placed = ready if placed is None else placed.unionByName(ready)
        rest = saved(waiting.join(ready, ["conv", "call_id"], "left_anti"), "chat-waiting")
        if waiting is not late:
            discard(waiting)
        waiting = rest
    marks = waiting.withColumn("level", F.lit(None).cast("int"))
    return marks if placed is None else marks.unionByName(placed)


def link_tools(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row for each (conv, call_id) that a call or a result names.

    calls(conv, turn, call_id, name, arguments, after): arguments is JSON text, after the ids of calls of the same
    conversation that must come first. results(conv, turn, call_id, content). Returns conv, call_id, turn, name, status
    (linked, unanswered, orphan for a result without call, cycle for a call with no order), position (from 0 among the
    conversation's calls that have an order, else null), n_calls, n_results, errors and json.

    Of repeated calls with one id the first by turn, name and arguments counts, of repeated results the first by turn and
    content. Rows without an id are left out, as nothing can be linked to them. A null conversation is one conversation.
    Unknown dependencies, unknown tools, and arguments that are null, no JSON or against their schema are listed in errors;
    json then holds them as text. NaN, Infinity and floats beyond a double's range are no JSON, nor are numbers or nestings
    too deep or long for the parser; lone surrogates stay escaped. Empty tables are fine; further columns are ignored.
    """
    text_batches(calls.sparkSession)
    call = F.struct(F.col("turn").cast("long").alias("turn"), F.col("name").cast("string").alias("name"), F.col("arguments").cast("string").alias("arguments"), F.array_sort(F.filter(F.coalesce("after", F.array().cast("array<string>")), lambda x: x.isNotNull())).alias("after"))
    c = calls.filter("call_id IS NOT NULL").groupBy(F.coalesce(F.col("conv").cast("string"), F.lit("")).alias("conv"), F.col("call_id").cast("string").alias("call_id"))
    c = saved(c.agg(F.min(call).alias("c"), F.count(F.lit(1)).alias("n_calls")).select("conv", "call_id", "c.*", "n_calls"), "chat-calls")
    r = results.filter("call_id IS NOT NULL").groupBy(F.coalesce(F.col("conv").cast("string"), F.lit("")).alias("conv"), F.col("call_id").cast("string").alias("call_id"))
    r = r.agg(F.min(F.struct(F.col("turn").cast("long").alias("turn"), F.col("content").cast("string").alias("content"))).alias("r"), F.count(F.lit(1)).alias("n_results"))

    levels = dependency_levels(c.select("conv", "call_id", "turn", "after"))
    order = c.select("conv", "call_id", F.coalesce("turn", F.lit(-1).cast("long")).alias("turn")).join(levels, ["conv", "call_id"])
    ranked = running_totals(order.filter("level IS NOT NULL").withColumn("one", F.lit(1).cast("long")), "conv", ["level", "turn", "call_id"], "one", "chat-order").select("conv", "call_id", F.col("rank").alias("position"))
    known = c.select("conv", "call_id", F.explode("after").alias("dep")).join(c.select("conv", F.col("call_id").alias("dep")), ["conv", "dep"], "left_anti")
    lost = known.groupBy("conv", "call_id").agg(F.array_sort(F.collect_set("dep")).alias("lost"))

    joined = c.join(r.hint("shuffle_hash"), ["conv", "call_id"], "full").join(ranked, ["conv", "call_id"], "left").join(lost, ["conv", "call_id"], "left")
    status = F.when(F.col("n_calls").isNull(), "orphan").when(F.col("position").isNull(), "cycle").when(F.col("n_results").isNull(), "unanswered").otherwise("linked")
    flat = joined.select("conv", "call_id", F.coalesce("turn", "r.turn").alias("turn"), "name", status.alias("status"), "position", F.coalesce("n_calls", F.lit(0)).cast("long").alias("n_calls"), F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), "arguments", F.col("r.content").alias("content"), F.col("r.turn").alias("result_turn"), "lost")
    schema = flat.drop("arguments", "content", "result_turn", "lost").schema.add("errors", T.ArrayType(T.StringType())).add("json", T.StringType())
    at = len(schema) - 2

    def serialise(batches):
        for batch in batches:
            errors, texts = [], []
            for row in batch.to_pylist():
                wrong = [f"dependency {x}: not known" for x in row["lost"] or []]
                arguments = row["arguments"]
                result = {"content": row["content"], "turn": row["result_turn"]} if row["n_results"] else None

                def whole(value):
                    call = {"id": row["call_id"], "name": row["name"], "arguments": value, "position": row["position"]} if row["n_calls"] else None
                    return canonical({"call": call, "result": result})

                try:
                    found, text = [], None
                    if row["n_calls"]:
                        value = parse_arguments(arguments)
                        found = violations(value, schemas[row["name"]]) if row["name"] in schemas else ["tool not known"]
                        text = whole(value)
                except (TypeError, ValueError, RecursionError):
                    found, text = ["$: no JSON"], None
                errors.append([_storable(x) for x in wrong + found])
                texts.append(whole(arguments) if text is None else text)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(errors, pa.list_(pa.string())), pa.array(texts, pa.string())], names=[*batch.schema.names[:at], "errors", "json"])

    return flat.mapInArrow(serialise, schema)


#: Tools for conversations that carry none: what a user's turn asks for is a call, the assistant's next turn its result.
TURN_SCHEMAS = {
    "answer": {"type": "object", "required": ["text", "words"], "additionalProperties": False, "properties": {"text": {"type": "string", "minLength": 1}, "words": {"type": "integer", "minimum": 1, "maximum": 200}}},
}


def turns_as_tools(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) from conversations(conv_id, turn, role, text): a user's turn calls, the assistant's next one answers.

    Turns of other roles, system turns among them, and turns without a number are neither. Of each four calls two turns
    apart the first waits for the second, which stands later, the third for the second, and the fourth for the first.
    """
    ident = lambda back: F.concat(F.lit("call-"), (F.col("turn") - back).cast("string"))
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    arguments = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("text"), words.alias("words")))
    place = F.shiftright("turn", 1) % 4
    back = F.when(place == 0, -2).when(place == 2, 2).when(place == 3, 6)
    calls = turns.filter("role = 'user' AND turn IS NOT NULL").select(F.col("conv_id").alias("conv"), "turn", ident(0).alias("call_id"), F.lit("answer").alias("name"), arguments.alias("arguments"), F.when(back.isNotNull(), F.array(ident(back))).alias("after"))
    results = turns.filter("role = 'assistant' AND turn IS NOT NULL").select(F.col("conv_id").alias("conv"), "turn", ident(1).alias("call_id"), F.col("text").alias("content"))
    return calls, results
