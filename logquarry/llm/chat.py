"""Chat formatting: tool calls linked to their results, ordered, checked, as canonical JSON.

An assistant message that is a JSON object with `tool_calls` [{id, name, arguments}] makes
calls; a `tool` message that is a JSON object with `tool_call_id` and `content` answers one.
Calls and results meet in a hash join on conversation and identifier; messages without
either pass by it.  The order is topological: a result comes right after the later of its
own turn and its call's, everything else stays in its turn.  It is given as a sort key
(order_turn, order_kind, turn), so no conversation has to be gathered.  Arguments are checked
against the schemas given by tool name.  The JSON has sorted keys and no spaces.

The first of several calls with one identifier (least turn and place) is the one that is
linked.  A call whose identifier no result has is unanswered; a result without its call keeps
its turn, unlinked.  Null texts read as empty content, null roles as the empty string; null
turns come first; a null conversation links nothing.  An identifier that is a number links as
the text of its digits.  What is not JSON (NaN and Infinity are not) is plain content, and half
a surrogate pair stays an escape.  Rows that repeat each yield a row.  An empty table yields
no rows.  Extra columns are not read.  Very long texts pass whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CALLS = "struct<tool_calls:array<struct<id:string,name:string,arguments:string>>>"
ANSWER = "struct<tool_call_id:string,content:string>"
RESULT = "conv_id long, turn long, order_turn long, order_kind int, n_calls long, n_answered long, linked boolean, n_invalid long, json string"
OPTIONS = {"allowNonNumericNumbers": "false"}
TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}
_HALF = re.compile("[\ud800-\udfff]")


def canonical(value) -> str:
    """JSON with sorted keys and no spaces; half a surrogate pair stays an escape."""
    return _HALF.sub(lambda m: f"\\u{ord(m[0]):04x}", json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def identifier(value) -> str | None:
    """An identifier as the join knows it: a number is the text of its digits."""
    return value if value is None or isinstance(value, str) else canonical(value)


def fits(value, schema: dict) -> bool:
    """Whether a value has one of the schema's types and enumerated values, and its parts fit theirs.

    An object with listed properties has no others unless additionalProperties is true."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds or []
    if kinds and not any(isinstance(value, TYPES.get(k, ())) and (k == "boolean" or not isinstance(value, bool)) for k in kinds):
        return False
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        return False
    if isinstance(value, dict):
        known = schema.get("properties")
        if any(k not in value for k in schema.get("required", ())):
            return False
        if known is not None and schema.get("additionalProperties") is not True and any(k not in known for k in value):
            return False
        return all(fits(v, known[k]) for k, v in value.items() if known and k in known)
    if isinstance(value, list) and isinstance(schema.get("items"), dict):
        return all(fits(v, schema["items"]) for v in value)
    return True


def valid(arguments, schema: dict | None) -> bool:
    """Whether arguments (parsed) are an object that fits the tool's schema; without a schema nothing does."""
    return schema is not None and isinstance(arguments, dict) and fits(arguments, {"properties": {}} | schema)


def parsed(text: str):
    def never(name):
        raise ValueError(name)

    try:
        return json.loads(text, parse_constant=never)
    except (ValueError, RecursionError):
        return None


def _writer(schemas: dict[str, dict]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            texts, invalid, calls = [], [], []
            for r in rows:
                role, content = r["role"] or "", r["text"] or ""
                message: dict = {"role": role, "content": content}
                bad, made = 0, None
                if r["tooled"]:
                    body = parsed(content)
                    if isinstance(body, dict) and role == "assistant" and isinstance(body.get("tool_calls"), list):
                        made = []
                        for c in body["tool_calls"]:
                            c = c if isinstance(c, dict) else {}
                            args = c.get("arguments")
                            args = parsed(args) if isinstance(args, str) else args
                            name = c.get("name")
                            ok = valid(args, schemas.get(name) if isinstance(name, str) else None)
                            bad += not ok
                            made.append({"id": c.get("id"), "name": name, "arguments": args, "answered": identifier(c.get("id")) in (r["answered"] or ()), "valid": ok})
                        message = {"role": role, "content": body.get("content"), "tool_calls": made}
                    elif isinstance(body, dict) and role == "tool":
                        message = {"role": role, "tool_call_id": body.get("tool_call_id"), "content": body.get("content")}
                texts.append(canonical(message)), invalid.append(bad), calls.append(len(made or ()))
            col = lambda name, kind: pa.array([r[name] for r in rows], kind)
            n_answered = pa.array([len(r["answered"] or ()) for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([col("conv_id", pa.int64()), col("turn", pa.int64()), col("order_turn", pa.int64()), col("order_kind", pa.int32()), pa.array(calls, pa.int64()), n_answered, col("linked", pa.bool_()), pa.array(invalid, pa.int64()), pa.array(texts, pa.string())], names=[x.split()[0] for x in RESULT.split(", ")])

    return run


def format_chats(conversations: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """One row per message, with its place in topological order and its canonical JSON."""
    m = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    tooled = F.coalesce((F.col("role").isin("assistant", "tool")) & F.ltrim("text").startswith("{") & F.col("text").rlike('"tool_call(s|_id)"'), F.lit(False))
    m = m.withColumn("tooled", tooled)
    none = F.array().cast("array<string>")
    plain = m.where(~F.col("tooled")).select("*", F.col("turn").alias("order_turn"), F.lit(0).alias("order_kind"), F.lit(False).alias("linked"), none.alias("answered"))
    tools = m.where("tooled").withColumn("made", F.from_json("text", CALLS, OPTIONS)["tool_calls"]).withColumn("answers", F.from_json("text", ANSWER, OPTIONS)["tool_call_id"])
    calls = tools.where("role = 'assistant'").select("conv_id", "turn", F.posexplode("made").alias("i", "c")).select("conv_id", F.col("c.id").alias("id"), F.struct("turn", "i").alias("at")).where("id is not null")
    calls = calls.groupBy("conv_id", "id").agg(F.min("at.turn").alias("call_turn"))
    results = tools.where("role = 'tool'")
    answered = results.select("conv_id", F.col("answers").alias("id")).where("id is not null").distinct()
    linked = results.join(calls.hint("shuffle_hash").withColumnRenamed("id", "answers"), ["conv_id", "answers"], "left")
    linked = linked.select("conv_id", "turn", "role", "text", "tooled", F.greatest("turn", "call_turn").alias("order_turn"), F.lit(1).alias("order_kind"), F.col("call_turn").isNotNull().alias("linked"), none.alias("answered"))
    ids = F.array_distinct(F.transform(F.coalesce("made", F.array().cast("array<struct<id:string,name:string,arguments:string>>")), lambda c: c["id"]))
    makers = tools.where("role = 'assistant'").withColumn("row", F.struct(F.col("conv_id"), F.col("turn"), F.xxhash64("text")))
    wanted = makers.select("row", "conv_id", F.explode(ids).alias("id")).join(answered.hint("shuffle_hash"), ["conv_id", "id"]).groupBy("row").agg(F.collect_set("id").alias("answered"))
    makers = makers.join(wanted, "row", "left").select("conv_id", "turn", "role", "text", "tooled", F.col("turn").alias("order_turn"), F.lit(0).alias("order_kind"), F.lit(False).alias("linked"), F.coalesce("answered", none).alias("answered"))
    return plain.unionByName(linked).unionByName(makers).mapInArrow(_writer(schemas or {}), RESULT)
