"""Chat formatting: links tool calls with their results and writes every message as canonical JSON.

Messages are rows of conv_id, turn, role and text. A text may hold calls as
<tool_call>{"id": ..., "name": ..., "arguments": {...}}</tool_call>; a message of the role "tool" is the
result {"tool_call_id": ..., "content": ...}; a system message may declare tools as
<tools>[{"name": ..., "parameters": {JSON schema}}, ...]</tools>.

1. Texts are parsed once; messages without calls pass through.
2. Calls and results are hash-joined on (conv_id, identifier); the first call of an identifier owns it.
3. Topological order: messages keep the order of turns, but a result never stands before its call. The
   place of a message is counted from a global sort, so that a conversation of any length is spread over
   tasks.
4. Arguments are validated against the schema that the conversation declares for the tool, else against
   the given ones.
5. Messages are written as JSON with sorted keys, no white space and characters as they are.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tessera.llm.common import checkpointed

_OPEN, _CLOSE = "<tool_call>", "</tool_call>"
_TOOLS_OPEN, _TOOLS_CLOSE = "<tools>", "</tools>"


def canonical(value: object) -> str:
    """JSON with sorted keys, no white space, characters as they are, whole floats as integers."""

    def plain(v: object) -> object:
        if isinstance(v, float) and v - v == 0 and v == int(v):
            return int(v)
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, list) else v

    return json.dumps(plain(value), ensure_ascii=False, sort_keys=True, separators=(",", ":"))


_KINDS = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}


def violations(value: object, schema: object, at: str = "$") -> list[str]:
    """What a value breaks of a JSON schema: type, enum, const, required, properties, additionalProperties, items, bounds and lengths."""
    if schema is True or not isinstance(schema, dict):
        return [] if schema is not False else [f"{at}: not allowed"]
    kinds = schema.get("type")
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    fits = {"number": number, "integer": number and value == int(value) if number and value - value == 0 else False}
    if kinds is not None and not any(fits.get(k, isinstance(value, _KINDS.get(k, ()))) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: not of type {kinds}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if "const" in schema and value != schema["const"]:
        out.append(f"{at}: not the constant")
    if number:
        out += [f"{at}: {what}" for key, what, bad in (("minimum", "too small", lambda b: value < b), ("maximum", "too large", lambda b: value > b)) if key in schema and bad(schema[key])]
    if isinstance(value, (str, list)):
        name = "Length" if isinstance(value, str) else "Items"
        out += [f"{at}: too short"] * (len(value) < schema.get(f"min{name}", 0)) + [f"{at}: too long"] * (len(value) > schema.get(f"max{name}", len(value)))
    if isinstance(value, list) and "items" in schema:
        out += [x for i, v in enumerate(value) for x in violations(v, schema["items"], f"{at}[{i}]")]
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{at}.{k}")
            elif "additionalProperties" in schema:
                out += violations(value[k], schema["additionalProperties"], f"{at}.{k}")
    return out


_CALL = "struct<id:string,name:string,arguments:string,error:string>"
_TOOL = "struct<name:string,schema:string>"
PARSED = f"conv_id long, turn long, role string, text string, content string, calls array<{_CALL}>, result_id string, tools array<{_TOOL}>"


def _cut(text: str, opened: str, closed: str) -> tuple[str, list[str]]:
    """The text without its marked parts, and those."""
    out, found, at = [], [], 0
    while (a := text.find(opened, at)) >= 0 and (b := text.find(closed, a)) >= 0:
        out.append(text[at:a])
        found.append(text[a + len(opened) : b])
        at = b + len(closed)
    return "".join([*out, text[at:]]), found


def _load(text: str) -> object:
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def parse(role: str | None, text: str | None) -> tuple:
    """Content, calls, identifier of the call that is answered, and declared tools of one message."""
    if text is None:
        return None, [], None, []
    if role == "tool":
        value = _load(text)
        if isinstance(value, dict) and "tool_call_id" in value:
            content = value.get("content")
            return content if isinstance(content, str) else canonical(content), [], str(value["tool_call_id"]), []
        return text, [], None, []
    calls, tools = [], []
    if _OPEN in text:
        text, found = _cut(text, _OPEN, _CLOSE)
        for body in found:
            value = _load(body)
            if not isinstance(value, dict) or not isinstance(value.get("name"), str):
                calls.append({"id": None, "name": None, "arguments": None, "error": "not a call"})
                continue
            given = value.get("arguments", {})
            given = _load(given) if isinstance(given, str) else given
            call = None if value.get("id") is None else str(value["id"])
            calls.append({"id": call, "name": value["name"], "arguments": canonical(given) if isinstance(given, dict) else None, "error": None if isinstance(given, dict) else "arguments are no object"})
    if role == "system" and _TOOLS_OPEN in text:
        text, found = _cut(text, _TOOLS_OPEN, _TOOLS_CLOSE)
        for value in map(_load, found):
            tools += [{"name": t["name"], "schema": canonical(t.get("parameters", True))} for t in value or [] if isinstance(t, dict) and isinstance(t.get("name"), str)] if isinstance(value, list) else []
    return text, calls, None, tools


def _parsed(messages: DataFrame) -> DataFrame:
    call = pa.list_(pa.struct([(n, pa.string()) for n in ("id", "name", "arguments", "error")]))
    tool = pa.list_(pa.struct([(n, pa.string()) for n in ("name", "schema")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse(r, t) for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            content, calls, results, tools = zip(*found, strict=True) if found else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(content, pa.string()), pa.array(calls, call), pa.array(results, pa.string()), pa.array(tools, tool)], ["conv_id", "turn", "role", "text", "content", "calls", "result_id", "tools"])

    return messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).mapInArrow(run, PARSED)


def _placed(ordered: DataFrame, keys: list[str]) -> DataFrame:
    """Adds position, the place of each row within its conv_id by `keys`, without gathering a conversation in one task.

    Rows are sorted by ranges, numbered within their task, and shifted by what earlier tasks hold of the conversation.
    """
    names = ordered.columns
    spread = ordered.repartitionByRange("conv_id", *keys).sortWithinPartitions("conv_id", *keys)
    schema = StructType([*ordered.schema, StructField("part", IntegerType()), StructField("local", LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, part = object(), 0, TaskContext.get().partitionId()
        at = names.index("conv_id")
        for batch in batches:
            local = []
            for conv in batch.column(at).to_pylist():
                n = n + 1 if conv == last else 0
                last = conv
                local.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(local), pa.int32()), pa.array(local, pa.int64())], [*names, "part", "local"])

    numbered = checkpointed(spread.mapInArrow(number, schema))
    held = numbered.groupBy("conv_id", "part").agg(F.count("*").alias("m"))  # a row for each task that has the conversation
    before = F.coalesce(F.sum("m").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    held = held.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), before.alias("before"))
    joined = numbered.join(held, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
    return joined.select(*names, (F.col("local") + F.col("before")).alias("position"))


FORMATTED = "conv_id long, position long, turn long, role string, message string, n_calls int, n_invalid int, answers_turn long, error string"


def format_chat(messages: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """One row for each row of messages (conv_id, turn, role, text) with its place in the conversation and its canonical JSON.

    message has content and role, for calls tool_calls (id, name, arguments), for a linked result tool_call_id.
    n_calls and n_invalid count a message's calls and those that break their schema, repeat an identifier or can't
    be read; answers_turn is the turn of the call that a result belongs to; error names the first problem
    (a result without its call is "orphan"). `schemas` are tools' JSON schemas by name, a bounded setting. Ties of turn
    are ordered by role and text; nulls come first and stay null; a null text has a null content.
    """
    given = {name: canonical(schema) for name, schema in (schemas or {}).items()}
    rows = checkpointed(_parsed(messages))
    calls = rows.select("conv_id", "turn", F.explode("calls").alias("call")).select("conv_id", "turn", "call.id").where("id is not null")
    owners = calls.groupBy("conv_id", "id").agg(F.min("turn").alias("call_turn"), F.count("*").alias("uses"))
    owners = owners.select(F.col("conv_id").alias("oc"), F.col("id").alias("oid"), "call_turn", "uses")
    linked = rows.join(owners, F.col("conv_id").eqNullSafe(F.col("oc")) & (F.col("result_id") == F.col("oid")), "left").drop("oc", "oid", "uses")
    after = F.greatest("turn", "call_turn")
    linked = linked.select("*", after.alias("after"), (F.col("call_turn") > F.col("turn")).cast("int").alias("late"))
    placed = _placed(linked, ["after", "late", "turn", "role", "text"])
    wanted = rows.select("conv_id", F.explode("tools").alias("tool")).select(F.col("conv_id").alias("tc"), F.struct("tool.name", "tool.schema").alias("tool"))
    used = rows.where(F.size("calls") > 0).select(F.col("conv_id").alias("uc")).distinct()
    # only conversations with calls need their tools; each conversation declares a bounded set of distinct ones
    declared = wanted.join(used, F.col("tc").eqNullSafe(F.col("uc")), "left_semi").distinct().groupBy("tc").agg(F.sort_array(F.collect_list("tool")).alias("declared"))
    repeated = owners.where("uses > 1").groupBy("oc").agg(F.collect_set(F.struct("oid", "call_turn")).alias("repeated"))
    full = placed.join(declared, F.col("conv_id").eqNullSafe(F.col("tc")), "left").join(repeated, F.col("conv_id").eqNullSafe(F.col("oc")), "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: dict[str, object] = {}

        def schema_of(text: str) -> object:
            return loaded.setdefault(text, json.loads(text)) if text not in loaded else loaded[text]

        for batch in batches:
            out = []
            for m in batch.to_pylist():
                body: dict = {"content": m["content"], "role": m["role"]}
                problems, invalid = [], 0
                if m["calls"]:
                    tools = {t["name"]: t["schema"] for t in reversed(m["declared"] or [])}
                    again = {r["oid"]: r["call_turn"] for r in m["repeated"] or []}
                    own: set[str] = set()
                    body["tool_calls"] = []
                    for c in m["calls"]:
                        found = [c["error"]] if c["error"] else []
                        arguments = _load(c["arguments"]) if c["arguments"] is not None else None
                        schema = tools.get(c["name"], given.get(c["name"]))
                        if not c["error"] and schema is not None:
                            found += violations(arguments, schema_of(schema))
                        elif not c["error"] and (tools or given):
                            found.append(f"unknown tool {c['name']}")
                        if c["id"] is not None and (c["id"] in own or c["id"] in again and again[c["id"]] != m["turn"]):
                            found.append(f"repeated id {c['id']}")
                        own.add(c["id"])
                        invalid += bool(found)
                        problems += found
                        body["tool_calls"].append({"arguments": arguments, "id": c["id"], "name": c["name"]})
                if m["result_id"] is not None:
                    body["tool_call_id"] = m["result_id"]
                    if m["call_turn"] is None:
                        problems.append("orphan")
                out.append((m["conv_id"], m["position"], m["turn"], m["role"], canonical(body), len(m["calls"]), invalid, m["call_turn"], problems[0] if problems else None))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
            columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in FORMATTED.split(", ")])

    return full.select("conv_id", "position", "turn", "role", "content", "calls", "result_id", "call_turn", "declared", "repeated").mapInArrow(write, FORMATTED)
