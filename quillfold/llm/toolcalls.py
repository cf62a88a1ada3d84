"""Chat formatting: tool calls linked to their results.

Calls and results meet in a hash join on (conversation, call id). Calls of a conversation stand in topological order:
each after the calls it depends on, otherwise by turn and id. Where every dependency already points to an
earlier (turn, id), that sort is a topological order; only conversations with a dependency that points ahead go through Kahn's
algorithm, level by level as joins, in as many rounds as their longest chain. Places in a conversation are counted by
ranges of its calls, so that one conversation may hold any share of all rows.
Arguments are checked against the JSON schema of the called function, and everything is serialised
as canonical JSON (keys sorted, no spaces, non-ASCII kept, as the key order of code points; a lone surrogate stays an escape).

Defined results: status is `linked`, `no_result`, `unknown_dependency` (which then counts as no dependency)
or `cycle` (such calls come last, by turn and id); an argument text is invalid if it is null, no JSON (NaN and infinities are
none), nested too deeply to be read, or holds a number beyond double, and then stands as text; calls or results with
a null conversation or id are dropped; of several results or calls of an id the first counts, by turn and
content; results without a call are dropped; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillfold.llm.common import carried, materialise, ranged, with_places

_TYPES = {"string": str, "boolean": bool, "array": list, "object": dict, "null": type(None)}
_SURROGATE = re.compile("[\ud800-\udfff]")


def _writable(text: str) -> str:
    """Lone surrogates, which UTF-8 cannot hold, as escapes."""
    return _SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value) -> str:
    return _writable(json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False))


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON")


def _number(text: str) -> float:
    value = float(text)
    if math.isinf(value):
        raise ValueError("beyond double")
    return value


def parse(text: str):
    """The value of a JSON text; ValueError or RecursionError where it has none."""
    return json.loads(text, parse_constant=_no_constant, parse_float=_number)


def _is(value, kind: str) -> bool:
    if kind in ("number", "integer"):
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        return number and (kind == "number" or isinstance(value, int) or value.is_integer())
    return isinstance(value, _TYPES[kind])


def same(a, b) -> bool:
    """Equality of JSON values: true is not 1."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    return a == b


def validate(value, schema: dict, path: str = "$") -> list[str]:
    """Errors of a value against a JSON schema: type, enum, required, properties, items, additionalProperties, bounds."""
    errors, kinds = [], schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds or []
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{path}: not {'/'.join(kinds)}"]
    if "enum" in schema and not any(same(value, x) for x in schema["enum"]):
        errors.append(f"{path}: not in enum")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if "minimum" in schema and value < schema["minimum"]:
            errors.append(f"{path}: below minimum")
        if "maximum" in schema and value > schema["maximum"]:
            errors.append(f"{path}: above maximum")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            errors.append(f"{path}: too short")
        if "maxLength" in schema and len(value) > schema["maxLength"]:
            errors.append(f"{path}: too long")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        errors += [f"{path}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                errors += validate(value[k], known[k], f"{path}.{k}")
            elif schema.get("additionalProperties", True) is False:
                errors.append(f"{path}.{k}: not allowed")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            errors += validate(x, schema["items"], f"{path}[{i}]")
    return errors


def format_call(name, arguments, result, schemas: dict) -> tuple[bool, str, str]:
    """Whether the arguments are valid, their errors, and the canonical JSON of call and result."""
    try:
        parsed = parse(arguments)
        errors = validate(parsed, schemas[name]) if name in schemas else [f"$: no function {name}"]
        text = canonical({"name": name, "arguments": parsed, "result": result})
    except RecursionError:
        errors, text = ["$: nested too deeply"], canonical({"name": name, "arguments": arguments, "result": result})
    except (TypeError, ValueError):
        errors, text = ["$: not JSON"], canonical({"name": name, "arguments": arguments, "result": result})
    return not errors, _writable("; ".join(errors)), text


def _levels(calls: DataFrame, needs: DataFrame, fold: int = 50) -> DataFrame:
    """conv_id, call_id, level: the longest chain of dependencies below; null in or behind a cycle, and only there.

    However long the chains are; every `fold` levels what is done becomes one table, so that the plan stays small.
    """
    done, left, level, edges = None, calls.select("conv_id", "call_id"), 0, needs
    while True:
        blocked = edges.select("conv_id", "call_id").distinct()
        free = materialise(left.join(blocked, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(level)))
        if free.isEmpty():
            break
        done = free if done is None else done.unionByName(free)
        names = free.select("conv_id", "call_id")
        left = materialise(left.join(names, ["conv_id", "call_id"], "left_anti"))
        edges = materialise(edges.join(names.withColumnRenamed("call_id", "needed"), ["conv_id", "needed"], "left_anti"))
        level += 1
        if level % fold == 0:
            done = materialise(done)
    rest = left.withColumn("level", F.lit(None).cast("int"))
    return rest if done is None else done.unionByName(rest)


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Link, order, validate and serialise.

    calls: conv_id, call_id, turn, name, arguments (JSON), depends_on (array of call ids);
    results: conv_id, call_id, turn, content. Returns conv_id, call_id, position (from 1 in each
    conversation), status, valid, errors and json.
    """
    key = ["conv_id", "call_id"]
    first = lambda df, *rest: df.where("conv_id IS NOT NULL AND call_id IS NOT NULL").groupBy(*key).agg(F.min(F.struct(F.coalesce("turn", F.lit(2**62)).alias("turn"), *rest)).alias("f")).select(*key, "f.*")
    calls = first(calls, "name", "arguments", "depends_on")
    results = first(results, "content").drop("turn")
    needs = calls.select(*key, "turn", F.explode("depends_on").alias("needed")).where("needed IS NOT NULL").distinct()
    needs = needs.join(calls.select("conv_id", F.col("call_id").alias("needed"), F.col("turn").alias("of_turn")), ["conv_id", "needed"], "left")
    bad = materialise(needs.where((F.col("of_turn") > F.col("turn")) | ((F.col("of_turn") == F.col("turn")) & (F.col("needed") >= F.col("call_id")))).select("conv_id").distinct())
    unknown = needs.where("of_turn IS NULL").select(*key).distinct().withColumn("_unknown", F.lit(True))
    linked = calls.join(results.withColumn("_linked", F.lit(True)), key, "left").join(unknown, key, "left")
    if bad.isEmpty():
        linked = linked.withColumn("level", F.lit(0))
    else:
        ahead = calls.join(bad, "conv_id", "left_semi")
        known = needs.where("of_turn IS NOT NULL").join(bad, "conv_id", "left_semi").select(*key, "needed")
        linked = linked.join(_levels(ahead, known).withColumn("_ahead", F.lit(True)), key, "left")
        linked = linked.withColumn("level", F.when(F.col("_ahead"), F.col("level")).otherwise(F.lit(0)))
    status = F.when(F.col("level").isNull(), "cycle").when(F.col("_unknown"), "unknown_dependency").when(F.col("_linked"), "linked").otherwise("no_result")
    ready = linked.select(*key, "level", "turn", status.alias("status"), "name", "arguments", "content")
    placed = with_places(ready, "conv_id", "position", F.col("level").asc_nulls_last(), F.col("turn"), F.col("call_id"))
    placed = placed.select(*key, "position", "status", "name", "arguments", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            found = [format_call(*row, schemas) for row in zip(*(part.column(i).to_pylist() for i in (4, 5, 6)), strict=True)]
            made = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.bool_(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(4)), *made], names=["conv_id", "call_id", "position", "status", "valid", "errors", "json"])

    return placed.mapInArrow(run, "conv_id long, call_id string, position int, status string, valid boolean, errors string, json string")


#: The one function that the turns of a plain dialogue are read as: the user asks, the assistant replies.
REPLY = {
    "type": "object",
    "required": ["prompt", "turn"],
    "additionalProperties": False,
    "properties": {"prompt": {"type": "string", "minLength": 1, "maxLength": 2000}, "turn": {"type": "integer", "minimum": 0}, "style": {"enum": ["plain", "brief"]}},
}


def dialogue_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Read each user turn as a call of `reply`, and the assistant's next turn before the next user turn as its result.

    A dialogue has neither dependencies nor faulty arguments, so both follow from a hash of conversation and turn: of eight
    calls three depend on the call before, one on the call after it (two such neighbours make a cycle), one on a call that
    is not there; of eleven, one's arguments are plain text, one's turn is a string, one's style is unknown.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    name = lambda turn: F.concat(F.lit("t"), F.lpad(turn.cast("string"), 12, "0"))
    users = rows.where("role = 'user' AND turn IS NOT NULL AND conv_id IS NOT NULL").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    users = materialise(with_places(users, "conv_id", "_place", F.col("turn")))
    near = lambda step, alias: users.select("conv_id", (F.col("_place") + step).alias("_place"), name(F.col("turn")).alias(alias))
    calls = users.join(near(1, "_before"), ["conv_id", "_place"], "left").join(near(-1, "_after"), ["conv_id", "_place"], "left")
    kind = lambda n: F.pmod(F.xxhash64("conv_id", "turn"), F.lit(n))
    needed = F.when(kind(8) < 3, F.col("_before")).when(kind(8) == 3, F.col("_after")).when(kind(8) == 4, "missing")
    turn = F.col("turn").cast("string")
    right = F.to_json(F.struct(F.col("text").alias("prompt"), "turn"))
    arguments = F.when(kind(11) == 0, F.col("text")).when(kind(11) == 1, F.to_json(F.struct(F.col("text").alias("prompt"), turn.alias("turn")))).when(kind(11) == 2, F.to_json(F.struct(F.col("text").alias("prompt"), "turn", F.lit("odd").alias("style")))).otherwise(right)
    calls = calls.select("conv_id", name(F.col("turn")).alias("call_id"), "turn", F.lit("reply").alias("name"), arguments.alias("arguments"), F.when(needed.isNotNull(), F.array(needed)).otherwise(F.array().cast("array<string>")).alias("depends_on"))

    # The last user turn before each assistant turn: of the same range, else what earlier ranges hold.
    spoken = ranged(rows.where("role IN ('user', 'assistant') AND turn IS NOT NULL AND conv_id IS NOT NULL"), "conv_id", F.col("turn"), F.col("role"))
    asks = F.when(F.col("role") == "user", F.col("turn"))
    earlier = carried(spoken, "conv_id", ("asked", F.max(asks), F.max))
    here = Window.partitionBy("conv_id", "_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    told = spoken.withColumn("_here", F.max(asks).over(here)).join(earlier, (F.col("conv_id") == F.col("_group")) & (F.col("_range") == F.col("_in")), "left")
    told = told.withColumn("_asks", F.coalesce("_here", "_asked")).where("role = 'assistant' AND _asks IS NOT NULL")
    results = told.select("conv_id", name(F.col("_asks")).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results
