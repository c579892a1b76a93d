"""Tool calls and their results: linking, ordering, validation, canonical JSON.

Calls and results are hash-joined on (conversation, identifier, occurrence):
the k-th result with an identifier belongs to the k-th call with it, so a
repeated identifier never multiplies rows.  Occurrences and final places are
global ranks minus the first rank of the key (``number_rows``): a conversation
or identifier that holds a third of all rows is spread over many tasks.

A call may name calls it depends on.  Dialogue order is kept wherever it is a
topological order, which one join of the dependencies shows.  Only the
conversations in which some call stands before one it needs go through Kahn's
algorithm in rounds: each round places the calls whose needs are all placed; a
round that places none leaves the rest as ``cyclic``.

Arguments are checked against the tool's JSON schema (type, properties,
required, additionalProperties, enum, items, minLength, minimum, maximum) and
written with sorted keys, no blanks and unescaped Unicode.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm.sharding import number_rows
from concord.session import materialize

_FENCE = re.compile(r"```tool_call\s*\n(.*?)```", re.S)
_MESSAGE = ("struct<calls: array<struct<call_id: string, name: string, arguments: string, after: array<string>>>, "
            "result: struct<call_id: string, content: string>>")


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


def parse_json(text: str):
    """The value of a JSON text; NaN and infinities are errors."""
    return json.loads(text, parse_constant=_no_constant)


_TYPES = {"string": lambda v: isinstance(v, str), "object": lambda v: isinstance(v, dict),
          "array": lambda v: isinstance(v, list), "boolean": lambda v: isinstance(v, bool), "null": lambda v: v is None,
          "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
          "integer": lambda v: not isinstance(v, bool) and (isinstance(v, int) or isinstance(v, float) and v.is_integer())}


def schema_error(value, schema: dict, path: str = "$") -> str | None:
    """The first way in which ``value`` breaks ``schema``, or None."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_TYPES[k](value) for k in kinds if k in _TYPES):
        return f"{path}: not {' or '.join(kinds)}"
    if "enum" in schema and canonical(value) not in {canonical(v) for v in schema["enum"]}:
        return f"{path}: not one of the allowed values"
    if isinstance(value, str) and len(value) < schema.get("minLength", 0):
        return f"{path}: too short"
    if _TYPES["number"](value):
        if "minimum" in schema and value < schema["minimum"]:
            return f"{path}: too small"
        if "maximum" in schema and value > schema["maximum"]:
            return f"{path}: too large"
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for name in sorted(schema.get("required", [])):
            if name not in value:
                return f"{path}.{name}: missing"
        for name in sorted(value):
            if name in known:
                if bad := schema_error(value[name], known[name], f"{path}.{name}"):
                    return bad
            elif schema.get("additionalProperties", True) is False:
                return f"{path}.{name}: unknown"
    if isinstance(value, list) and "items" in schema:
        for k, v in enumerate(value):
            if bad := schema_error(v, schema["items"], f"{path}[{k}]"):
                return bad
    return None


# ------------------------------------------------------------------- messages
def _read_message(role: str | None, text: str | None) -> dict:
    """Tool calls of an assistant message (fenced ``tool_call`` objects) or the result in a tool message."""
    out: dict = {"calls": [], "result": None}
    if role == "assistant":
        for block in _FENCE.findall(text or ""):
            try:
                call = parse_json(block)
            except ValueError:
                continue
            if isinstance(call, dict):
                out["calls"].append({
                    "call_id": None if call.get("id") is None else str(call["id"]), "name": str(call.get("name", "")),
                    "arguments": canonical(call.get("arguments", {})), "after": [str(x) for x in call.get("after") or []]})
    elif role == "tool":
        try:
            got = parse_json(text or "")
        except ValueError:
            got = {"content": text}
        got = got if isinstance(got, dict) else {"content": got}
        content = got.get("content")
        out["result"] = {"call_id": None if got.get("tool_call_id") is None else str(got["tool_call_id"]),
                         "content": content if isinstance(content, str) or content is None else canonical(content)}
    return out


def read_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """messages(conv_id, turn, role, text) -> (calls, results) as ``link_tool_calls`` takes them.

    Text that is no JSON holds no call; a tool message that is none is a result without identifier."""
    @F.arrow_udf(_MESSAGE)
    def read(role: pa.Array, text: pa.Array) -> pa.Array:
        s = pa.string()
        call = pa.struct([("call_id", s), ("name", s), ("arguments", s), ("after", pa.list_(s))])
        kind = pa.struct([("calls", pa.list_(call)), ("result", pa.struct([("call_id", s), ("content", s)]))])
        return pa.array([_read_message(r, t) for r, t in zip(role.to_pylist(), text.to_pylist())], kind)

    got = messages.select("conv_id", "turn", read("role", "text").alias("m"))
    calls = got.select("conv_id", "turn", F.posexplode("m.calls").alias("k", "c")).select(
        "conv_id", (F.col("turn").cast("bigint") * 1000 + F.col("k")).alias("position"), "c.*")
    results = got.where("m.result is not null").select("conv_id", (F.col("turn").cast("bigint") * 1000).alias("position"), "m.result.*")
    return calls, results


#: The tool that a plain dialogue calls: every user turn asks it, the assistant turn after it answers.
REPLY = {"type": "object", "required": ["prompt", "turn"], "additionalProperties": False,
         "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}}


def dialogue_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A plain dialogue as calls of ``reply``: a user turn is a call that needs the
    user turn two turns before; an assistant turn is the result of the turn before it."""
    ident = lambda back: F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))
    turn = F.col("turn").cast("bigint").alias("position")

    @F.arrow_udf("string")
    def arguments(text: pa.Array, turn: pa.Array) -> pa.Array:
        return pa.array([canonical({"prompt": t, "turn": n}) for t, n in zip(text.to_pylist(), turn.to_pylist())], pa.string())

    # a user turn that opens the dialogue (after the system's, if there is one) needs no other
    calls = conversations.where("role = 'user'").select(
        "conv_id", turn, ident(0).alias("call_id"), F.lit("reply").alias("name"), arguments("text", "turn").alias("arguments"),
        F.when(F.col("turn") >= 2, F.array(ident(2))).otherwise(F.array().cast("array<string>")).alias("after"))
    results = conversations.where("role = 'assistant'").select(
        "conv_id", turn, ident(1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


# -------------------------------------------------------------------- linking
def _ranked(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Add ``name``: the place of a row among those with its keys, from 0."""
    rows, _ = number_rows(df, [*keys, *order])
    rows = materialize(rows, "ranked")
    first = rows.groupBy(*keys).agg(F.min("row_number").alias("__first")).withColumnsRenamed({k: f"__{k}" for k in keys})
    met = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"__{k}"))
        met = c if met is None else met & c
    return rows.join(first, met).withColumn(name, F.col("row_number") - F.col("__first")).drop(
        "row_number", "__first", *[f"__{k}" for k in keys])


def _levels(calls: DataFrame) -> DataFrame:
    """calls(conv_id, call_id, k, position, after) -> (conv_id, call_id, k, level, problem).

    ``level`` is 0 for all calls of a conversation whose dialogue order is
    topological; ``problem``: unknown dependency or cyclic, else null."""
    key = ["conv_id", "call_id", "k"]
    needs = calls.select(*key, "position", F.explode(F.array_distinct("after")).alias("need"))
    target = calls.where("k = 0").select(F.col("conv_id").alias("c"), F.col("call_id").alias("need_id"),
                                         F.col("position").alias("need_position"))
    edges = materialize(needs.join(target, needs.conv_id.eqNullSafe(target.c) & (needs.need == target.need_id), "left")
                        .select(*key, "position", "need", "need_position"), "needs")
    unknown = edges.where("need_position is null").select(*key).distinct().withColumn("unknown", F.lit(True))
    late = edges.where((F.col("need_position") > F.col("position"))
                       | (F.col("need_position").isNotNull() & (F.col("need") == F.col("call_id")) & (F.col("k") == 0)))
    tangled = late.select("conv_id").distinct()
    base = calls.select(*key)
    if tangled.isEmpty():
        placed = base.select(*key, F.lit(0).alias("level"), F.lit(False).alias("cyclic"))
    else:
        t = tangled.withColumnRenamed("conv_id", "__c")
        inside = lambda df, how: df.join(t, df.conv_id.eqNullSafe(F.col("__c")), how)               # noqa: E731
        rest = materialize(inside(base, "left_semi"), "tangled")
        open_edges = materialize(inside(edges.where("need_position is not null"), "left_semi").select(
            *key, F.col("need")), "tangled-needs")
        done = inside(base, "left_anti").select(*key, F.lit(0).alias("level"), F.lit(False).alias("cyclic"))
        level = 0
        while not rest.isEmpty():
            r, e = rest, open_edges.select(*[F.col(c).alias(f"e_{c}") for c in key]).distinct()
            same = r.conv_id.eqNullSafe(e.e_conv_id) & r.call_id.eqNullSafe(e.e_call_id) & (r.k == e.e_k)
            free = materialize(r.join(e, same, "left_anti"), "free")
            if free.isEmpty():
                done = done.union(rest.select(*key, F.lit(level).alias("level"), F.lit(True).alias("cyclic")))
                break
            done = done.union(free.select(*key, F.lit(level).alias("level"), F.lit(False).alias("cyclic")))
            f = free.select(*[F.col(c).alias(f"f_{c}") for c in key])
            rest = materialize(r.join(f, r.conv_id.eqNullSafe(f.f_conv_id) & r.call_id.eqNullSafe(f.f_call_id) & (r.k == f.f_k),
                                      "left_anti"), "tangled")
            g = f.where("f_k = 0")
            open_edges = materialize(open_edges.join(g, open_edges.conv_id.eqNullSafe(g.f_conv_id) & (open_edges.need == g.f_call_id),
                                                     "left_anti"), "tangled-needs")
            level += 1
        placed = done
    u = unknown.withColumnsRenamed({c: f"u_{c}" for c in key})
    return placed.join(u, placed.conv_id.eqNullSafe(u.u_conv_id) & placed.call_id.eqNullSafe(u.u_call_id) & (placed.k == u.u_k),
                       "left").select(*key, "level", F.when(F.col("cyclic"), "cyclic").when(
                           F.col("unknown"), "unknown dependency").alias("problem"))


def _check(schemas: dict[str, dict]) -> Column:
    @F.arrow_udf("struct<error: string, json: string>")
    def run(name: pa.Array, call_id: pa.Array, arguments: pa.Array, content: pa.Array, status: pa.Array) -> pa.Array:
        out = []
        for n, i, a, c, s in zip(*(x.to_pylist() for x in (name, call_id, arguments, content, status))):
            error, value = None, None
            if s != "orphan":
                try:
                    value = parse_json(a or "")
                    error = "unknown tool" if n not in schemas else schema_error(value, schemas[n])
                except (ValueError, RecursionError):
                    error = "$: not JSON"
            out.append({"error": error, "json": canonical({"arguments": value, "id": i, "name": n, "result": c})})
        return pa.array(out, pa.struct([("error", pa.string()), ("json", pa.string())]))

    return run("name", "call_id", "arguments", "content", "status")


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """calls(conv_id, position, call_id, name, arguments, after) and
    results(conv_id, position, call_id, content) -> a row for each call and each
    result without a call: (conv_id, ord, call_id, name, status, error, json).

    ``ord`` is the place in the conversation's topological order, from 0 (ties
    by position, then identifier); results without a call come last.  ``status``:
    linked, unanswered or orphan; a null identifier links to nothing.
    ``schemas`` maps tools to JSON schemas and travels to the tasks.  A null
    conv_id is a conversation of its own; repeated rows are occurrences of one
    identifier and link one to one."""
    called = materialize(_ranked(calls, ["conv_id", "call_id"], ["position", "name", "arguments"], "k"), "calls")
    answers = _ranked(results.select("conv_id", "position", "call_id", "content"), ["conv_id", "call_id"], ["position", "content"], "k") \
        .withColumnsRenamed({"conv_id": "r_conv", "call_id": "r_id", "k": "r_k", "position": "r_position"})
    level = _levels(called.select("conv_id", "call_id", "k", "position", "after")).withColumnsRenamed(
        {"conv_id": "l_conv", "call_id": "l_id", "k": "l_k"})
    placed = called.join(level, called.conv_id.eqNullSafe(level.l_conv) & called.call_id.eqNullSafe(level.l_id) & (called.k == level.l_k)) \
        .drop("l_conv", "l_id", "l_k")
    met = placed.join(answers, placed.conv_id.eqNullSafe(answers.r_conv) & (placed.call_id == answers.r_id) & (placed.k == answers.r_k), "full")
    is_call = F.col("k").isNotNull()
    linked = met.select(
        F.when(is_call, F.col("conv_id")).otherwise(F.col("r_conv")).alias("conv_id"),
        F.when(is_call, F.col("call_id")).otherwise(F.col("r_id")).alias("call_id"),
        "name", "arguments", "content", "problem",
        F.when(~is_call, "orphan").when(F.col("r_k").isNotNull(), "linked").otherwise("unanswered").alias("status"),
        (~is_call).alias("last"), F.coalesce("level", F.lit(0)).alias("level"),
        F.coalesce("position", "r_position").alias("position"))
    ordered = _ranked(linked, ["conv_id"], ["last", "level", "position", "call_id", "arguments", "content"], "ord")
    return ordered.withColumn("checked", _check(schemas)).select(
        "conv_id", "ord", "call_id", "name", "status", F.coalesce("problem", "checked.error").alias("error"), "checked.json")


def reply_calls(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The linked calls of plain dialogues."""
    return link_tool_calls(*dialogue_calls(conversations), {"reply": REPLY})
