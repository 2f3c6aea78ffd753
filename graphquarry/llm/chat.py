"""Chat formatting: tool calls linked to their results, ordered, validated, as canonical JSON.

A message's text is plain unless it is a JSON object of one of three forms:

* ``{"content": ..., "tool_calls": [{"id", "name", "arguments"}, ...]}`` holds
  calls; ``arguments`` is an object, or a string that holds one;
* ``{"tool_call_id": ..., "content": ...}`` is the result of a call;
* ``{"tool_results": [{"tool_call_id", "content"}, ...]}`` holds several.

Calls and results of a conversation are hash-joined by identifier. A call
depends on the calls that its arguments name as ``{"$ref": id}``, or as a
string ``"$id"`` if the conversation has a call of that identifier. Its level
is one more than the highest level it depends on, and calls of one message are
in the order of levels, ties by position. A cycle, or a ``$ref`` to no call,
leaves the level null. Chains of calls that depend on one call each are
shortened by pointer doubling, so rounds over the tables grow with the log of a
chain and with how often dependencies meet, not with a chain's length.
Arguments are checked against the tool's schema (type, required, properties,
items, enum, minimum, maximum, additionalProperties). No conversation is ever
gathered in one task: rows carry their order as columns.

Conversations without tool calls can be given some: ``derived`` makes each line
of a user's turn a call and the lines of the turn after it their results.

Defined results: null texts are empty content; null roles and ids stay null;
repeated identifiers link to every call of that identifier and are reported as
``duplicate``; results without a call are ``orphan``; repeated rows stay; texts
and nesting of any length and depth are handled, but a text that is too deep
for the JSON parser is plain; NaN and infinite numbers are not JSON; a lone
surrogate is escaped in JSON and U+FFFD elsewhere; empty tables give empty
tables; extra columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphquarry.llm.common import stage_table

KINDS = {"object": dict, "array": list, "string": str, "integer": int, "number": (int, float), "boolean": bool, "null": type(None)}


#: What ``derived`` calls, and the schema of its arguments.
LINE_TOOL = "answer_line"
LINE_SCHEMAS = {
    LINE_TOOL: {
        "type": "object",
        "required": ["text", "words"],
        "properties": {"text": {"type": "string"}, "words": {"type": "integer", "minimum": 1, "maximum": 40}, "after": {"type": "array"}},
        "additionalProperties": False,
    }
}


def _leaf(value) -> str:
    out = json.dumps(value, ensure_ascii=False, allow_nan=False)
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", out) if isinstance(value, str) else out


def canonical(value) -> str:
    """JSON with sorted keys, no spare space, and characters as they are; of any depth."""
    out: list[str] = []
    todo: list = [(value, False)]
    while todo:
        x, written = todo.pop()
        if written:
            out.append(x)
        elif isinstance(x, dict):
            parts = [[(f"{',' if i else ''}{_leaf(k)}:", True), (x[k], False)] for i, k in enumerate(sorted(x))]
            todo += [("}", True), *(p for pair in reversed(parts) for p in reversed(pair)), ("{", True)]
        elif isinstance(x, list):
            parts = [[(",", True), (y, False)] if i else [(y, False)] for i, y in enumerate(x)]
            todo += [("]", True), *(p for pair in reversed(parts) for p in reversed(pair)), ("[", True)]
        else:
            out.append(_leaf(x))
    return "".join(out)


def _number(text: str) -> float:
    x = float(text)
    if not math.isfinite(x):
        raise ValueError(f"not a JSON number: {text}")
    return x


def _loaded(text: str):
    """The JSON value, or ValueError."""
    try:
        return json.loads(text, parse_float=_number, parse_constant=_number)
    except RecursionError as e:
        raise ValueError("nested too deep") from e


def _clean(text: str) -> str:
    return re.sub("[\ud800-\udfff]", "\ufffd", text)


def problems(value, schema: dict, at: str = "$") -> list[str]:
    """What is wrong with ``value`` under ``schema``, in order."""
    out: list[str] = []
    kind = schema.get("type")
    if kind is not None:
        kinds = kind if isinstance(kind, list) else [kind]
        fits = any(isinstance(value, KINDS[k]) and (k in ("boolean",) or not isinstance(value, bool)) for k in kinds if k in KINDS)
        if not fits:
            return [f"{at}: not {'/'.join(kinds)}"]
    if "enum" in schema and not any(type(value) is type(x) and value == x for x in schema["enum"]):
        out.append(f"{at}: not in enum")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if "minimum" in schema and value < schema["minimum"]:
            out.append(f"{at}: below minimum")
        if "maximum" in schema and value > schema["maximum"]:
            out.append(f"{at}: above maximum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += problems(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: not allowed")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += problems(x, schema["items"], f"{at}[{i}]")
    return out


def references(value) -> tuple[set[str], set[str]]:
    """Identifiers by ``$ref``, and those that strings may mean."""
    sure, maybe, todo = set(), set(), [value]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if x.startswith("$") and len(x) > 1:
                maybe.add(_clean(x[1:]))
        elif isinstance(x, dict):
            if set(x) == {"$ref"}:
                sure.add(_text(x["$ref"]))
            else:
                todo += x.values()
        elif isinstance(x, list):
            todo += x
    return sure, maybe - sure


def parse(text: str | None) -> tuple[str, list[dict], list[tuple[str | None, str]]]:
    """Content, calls, and (identifier, content) of the results that a message holds."""
    text = text or ""
    if text.lstrip()[:1] == "{":
        try:
            got = _loaded(text)
        except ValueError:
            return text, [], []
        if not isinstance(got, dict):
            return text, [], []
        for key in ("tool_calls", "tool_results"):
            if isinstance(got.get(key), list) and all(isinstance(c, dict) for c in got[key]):
                if key == "tool_calls":
                    return _text(got.get("content")), got[key], []
                return _text(got.get("content")), [], [(None if r.get("tool_call_id") is None else _text(r["tool_call_id"]), _text(r.get("content"))) for r in got[key]]
        if got.get("tool_call_id") is not None:
            return "", [], [(_text(got["tool_call_id"]), _text(got.get("content")))]
    return text, [], []


def _text(x) -> str:
    return "" if x is None else _clean(x) if isinstance(x, str) else canonical(x)


def derived(messages: DataFrame) -> DataFrame:
    """Conversations whose user turns call a tool and whose next turns answer.

    Line k (from 0, blank ones left out) of a user's turn t becomes a call of
    LINE_TOOL with identifier "t.k" and arguments text, words (its number of
    words) and after: a ``$ref`` to line k - 1, and of the last of three lines
    or more to line 0 too. A turn t of any other role but "system" becomes
    results, its line k answering call "t-1.k". System turns stay.
    """

    def run(batches):
        for b in batches:
            texts = []
            for turn, role, text in zip(b.column("turn").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist()):
                lines = [x for x in (text or "").split("\n") if x.strip()]
                if role == "user":
                    calls = []
                    for k, x in enumerate(lines):
                        after = [*([k - 1] if k else []), *([0] if k > 1 and k == len(lines) - 1 else [])]
                        calls.append({"id": f"{turn}.{k}", "name": LINE_TOOL, "arguments": {"text": x, "words": len(x.split()), "after": [{"$ref": f"{turn}.{j}"} for j in after]}})
                    text = json.dumps({"content": None, "tool_calls": calls})
                elif role != "system":
                    before = None if turn is None else turn - 1
                    text = json.dumps({"content": None, "tool_results": [{"tool_call_id": f"{before}.{k}", "content": x} for k, x in enumerate(lines)]})
                texts.append(text)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("conv_id", "turn", "role")), pa.array(texts, pa.string())], names=["conv_id", "turn", "role", "text"])

    m = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return m.mapInArrow(run, "conv_id long, turn long, role string, text string")


_EVENT = "conv_id long, turn long, role string, kind string, pos int, call_id string, name string, arguments string, deps array<string>, mentions array<string>, errors array<string>, content string"


def _events(batches: Iterator[pa.RecordBatch], schemas: dict[str, dict]) -> Iterator[pa.RecordBatch]:
    texts = pa.list_(pa.string())
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), texts, texts, texts, pa.string()]
    names = [x.split()[0] for x in _EVENT.split(", ")]
    for b in batches:
        rows = []
        for conv, turn, role, text in zip(*(b.column(i).to_pylist() for i in range(4))):
            content, calls, results = parse(text)
            if not results or content:
                rows.append((conv, turn, role, "message", -1, None, None, None, [], [], [], content))
            for pos, (call_id, content) in enumerate(results):
                rows.append((conv, turn, role, "result", pos, call_id, None, None, [], [], [], content))
            for pos, c in enumerate(calls):
                args, errors = c.get("arguments", {}), []
                if isinstance(args, str):
                    try:
                        args = _loaded(args)
                    except ValueError:
                        errors.append("$: not JSON")
                name = _text(c.get("name"))
                if not errors:
                    errors = [_clean(e) for e in problems(args, schemas[name])] if name in schemas else ["$: no schema"] if schemas else []
                deps, mentions = references(args)
                rows.append((conv, turn, role, "call", pos, None if c.get("id") is None else _text(c["id"]), name, canonical(args), sorted(deps), sorted(mentions), errors, None))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(kinds), kinds)], names=names)


def _levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """conv_id, call_id and level of the calls that have one.

    ``nodes`` (conv_id, call_id) and ``edges`` (conv_id, call_id, dep) are
    distinct tables. Calls with one dependency are pointers, which doubling
    leads to a call with none or several; then each round settles the calls
    whose dependencies are all settled.
    """
    key = ["conv_id", "call_id"]
    many = edges.groupBy(*key).agg(F.count("*").alias("n"), F.first("dep").alias("to"))
    jump = stage_table(many.where("n = 1").select(*key, "to", F.lit(1).cast("long").alias("w")))
    size = jump.count()
    for _ in range(size.bit_length() + 1 if size else 0):
        far = jump.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("w").alias("more"))
        longer = jump.join(far, ["conv_id", "to"], "left").select(*key, F.coalesce("next", "to").alias("to"), (F.col("w") + F.coalesce("more", F.lit(0))).alias("w"), F.col("next").isNotNull().alias("moved"))
        longer = stage_table(longer, size)
        jump = longer.drop("moved")
        if longer.where("moved").head() is None:
            break
    # where a dependency leads and how far it is; a cycle of pointers leads to none that gets a level
    ends = edges.join(many.where("n > 1").select(*key), key, "left_semi")
    ends = ends.join(jump.select("conv_id", F.col("call_id").alias("dep"), "to", "w"), ["conv_id", "dep"], "left")
    ends = stage_table(ends.select(*key, F.coalesce("to", "dep").alias("to"), (F.coalesce("w", F.lit(0)) + 1).alias("w")))
    levels = stage_table(nodes.join(many.select(*key), key, "left_anti").withColumn("level", F.lit(0).cast("long")))
    fresh, left = levels, ends
    while left.head() is not None:
        known = levels.select("conv_id", F.col("call_id").alias("to"), "level")
        settled = left.join(known, ["conv_id", "to"], "left").groupBy(*key).agg(F.max(F.col("level") + F.col("w")).alias("level"), F.count_if(F.col("level").isNull()).alias("open"))
        fresh = stage_table(settled.where("open = 0").select(*key, "level"))
        if fresh.head() is None:
            break
        levels = stage_table(levels.union(fresh))
        left = stage_table(left.join(fresh.select(*key), key, "left_anti"))
    chained = jump.join(levels.select("conv_id", F.col("call_id").alias("to"), "level"), ["conv_id", "to"]).select(*key, (F.col("level") + F.col("w")).alias("level"))
    return levels.union(chained).select(*key, F.col("level").cast("int").alias("level"))


def link(messages: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """One row per message, call and result; see the module for the columns.

    conv_id, turn, role, kind, pos, level, call_id, name, arguments, status,
    errors, content, json. ``(turn, level, pos)`` is the order within a
    conversation, with unresolved levels last.
    """
    m = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    events = stage_table(m.mapInArrow(lambda x: _events(x, schemas or {}), _EVENT))
    calls = events.where("kind = 'call'")

    nodes = calls.where("call_id is not null and conv_id is not null").select("conv_id", "call_id").distinct()
    sure = calls.where("size(deps) > 0 and call_id is not null").select("conv_id", "call_id", F.explode("deps").alias("dep"))
    maybe = calls.where("size(mentions) > 0 and call_id is not null").select("conv_id", "call_id", F.explode("mentions").alias("dep"))
    maybe = maybe.join(nodes.select("conv_id", F.col("call_id").alias("dep")), ["conv_id", "dep"], "left_semi").select("conv_id", "call_id", "dep")
    levels = _levels(nodes, stage_table(sure.union(maybe).distinct()))

    per_id = calls.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.count("*").alias("n_calls"), F.min(F.struct("turn", "pos")).alias("first"))
    results = events.where("kind = 'result'").groupBy("conv_id", "call_id").agg(F.count("*").alias("n_results"))
    ids = per_id.join(results, ["conv_id", "call_id"], "full").join(levels, ["conv_id", "call_id"], "left")
    # what has no identifier meets nothing, and doesn't gather by conversation
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    out = events.where(named).join(ids, ["conv_id", "call_id"], "left").unionByName(events.where(~named), allowMissingColumns=True)
    status = (
        F.when(F.col("kind") == "message", F.lit(None).cast("string"))
        .when(F.col("n_calls").isNull(), "orphan")
        .when((F.col("n_calls") > 1) | (F.coalesce("n_results", F.lit(0)) > 1), "duplicate")
        .when(F.col("n_results").isNull(), "unanswered")
        .when((F.col("kind") == "result") & (F.col("turn") < F.col("first.turn")), "early")
        .otherwise("linked")
    )
    level = F.when(F.col("kind") == "call", F.col("level")).when(F.col("kind") == "message", F.lit(-1)).otherwise(F.lit(0))
    out = out.select("conv_id", "turn", "role", "kind", "pos", level.alias("level"), "call_id", "name", "arguments", status.alias("status"), "errors", "content")

    def written(batches):
        for b in batches:
            lines = []
            for r in b.select([c for c in b.schema.names if c not in ("conv_id", "turn", "pos", "level")]).to_pylist():
                got = {"status": r["status"]} if r["status"] else {}
                if r["kind"] == "call":
                    got |= {"id": r["call_id"], "name": r["name"]} | ({"errors": r["errors"]} if r["errors"] else {})
                    lines.append(f'{{"arguments":{r["arguments"]},{canonical(got)[1:]}')
                elif r["kind"] == "result":
                    lines.append(canonical(got | {"content": r["content"], "role": r["role"], "tool_call_id": r["call_id"]}))
                else:
                    lines.append(canonical(got | {"content": r["content"], "role": r["role"]}))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lines, pa.string())], names=[*b.schema.names, "json"])

    schema = "conv_id long, turn long, role string, kind string, pos int, level int, call_id string, name string, arguments string, status string, errors array<string>, content string, json string"
    return out.mapInArrow(written, schema)
