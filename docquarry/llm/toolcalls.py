"""Tool-call linking: calls and results joined by identifier, ordered, validated, serialised.

Messages are rows (conv_id, turn, role, text, call_id, tool, arguments, depends_on). A call has
call_id, tool and arguments; a result has role `tool` and call_id; others have none.

1. Link: of the calls with one identifier within a conversation the first (by turn, then text) is
   canonical, likewise of results; later ones are marked duplicates. So both sides of the hash
   join have one row per identifier, and repeated rows never multiply. Identifiers are reduced
   with map-side combine, and a conversation of any size is many small keys.
2. Order: every message has a place (position, hops). A message comes at its own turn, unless it
   must wait: a result for its call, a call for the results of the calls it depends on. Position
   is the largest turn on which it waits, hops count the messages in between. This is the fixed
   point of one join per step; the first step already shows that messages in their natural order
   are settled. (position, hops, turn) is a topological order of the conversation. Members of
   cycles never settle; once steps exceed the number of unsettled messages they get status
   `cycle` and a null place.
3. Arguments are validated against the tool's JSON schema (type, properties, required,
   additionalProperties, enum, minLength, maxLength, minimum, maximum, items).
4. A message is serialised as canonical JSON: keys sorted by code point, no blanks, no escapes
   beyond those that JSON needs, numbers as integers or shortest decimals.

Defined cases: null conversations or identifiers link with nothing; a null turn counts as 0;
repeated rows each give a row, the later ones as duplicates; null texts are JSON null; arguments
that are no JSON, nest too deep or have numbers beyond doubles are serialised as the string that
they are, with the error `$: not JSON`; lone surrogates stay escaped; null tools make no call; other
columns are left out; empty tables give empty results.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import table, written
from ._text import column


_LONE = re.compile("[\ud800-\udfff]")


def _quoted(text: str) -> str:
    """A JSON string; lone surrogates, which UTF-8 can't hold, stay escaped."""
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", json.dumps(text, ensure_ascii=False))


def canonical(value) -> str:
    """Canonical JSON of a parsed value; non-finite numbers are refused."""
    if isinstance(value, str):
        return _quoted(value)
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError("a number isn't finite")
        return str(int(value)) if value.is_integer() and abs(value) < 2**53 else repr(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{_quoted(k)}:{canonical(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    return json.dumps(value)


_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(value, kind: str) -> bool:
    if kind in ("number", "integer"):
        if isinstance(value, float):
            return kind == "number" or value.is_integer()
        return isinstance(value, int) and not isinstance(value, bool)
    return isinstance(value, _KINDS[kind])


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """What of a JSON value doesn't fit a schema, as 'place: rule'."""
    kinds = schema.get("type")
    if kinds and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: type"]
    out = []
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):  # true isn't 1
        out.append(f"{at}: enum")
    if isinstance(value, str):
        out += [f"{at}: {rule}" for rule, bad in (("minLength", len(value) < schema.get("minLength", 0)), ("maxLength", len(value) > schema.get("maxLength", len(value)))) if bad]
    if _is(value, "number"):
        out += [f"{at}: {rule}" for rule, bad in (("minimum", value < schema.get("minimum", value)), ("maximum", value > schema.get("maximum", value))) if bad]
    if isinstance(value, list) and "items" in schema:
        for k, x in enumerate(value):
            out += violations(x, schema["items"], f"{at}[{k}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: required" for k in schema.get("required", ()) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: additionalProperties")
    return out


_CHECKED = "valid boolean, errors array<string>, json string"


def _serialised(batches: Iterator[pa.RecordBatch], schemas: dict[str, dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    names = ("role", "text", "call_id", "tool", "arguments", "depends_on", "is_call")
    for batch in batches:
        valid, errors, texts = [], [], []
        for role, text, call, tool, arguments, depends, is_call in zip(*(column(batch, c).to_pylist() for c in names), strict=True):
            wrong, more = None, ""
            if is_call:
                try:
                    parsed = json.loads(arguments, parse_constant=lambda x: (_ for _ in ()).throw(ValueError(x)))
                    said = canonical(parsed)
                    wrong = violations(parsed, schemas[tool]) if tool in schemas else ["$: unknown tool"]
                except (TypeError, ValueError, RecursionError):
                    said, wrong = canonical(arguments), ["$: not JSON"]
                waits = f'"depends_on":{canonical(sorted({x for x in depends if x is not None}))},' if depends else ""
                more = f',"tool_call":{{"arguments":{said},{waits}"id":{canonical(call)},"name":{canonical(tool)}}}'
            elif call is not None:
                more = f',"tool_call_id":{canonical(call)}'
            valid.append(None if wrong is None else not wrong)
            errors.append([_LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", x) for x in wrong or []])
            texts.append(f'{{"content":{canonical(text)},"role":{canonical(role)}{more}}}')
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(valid, pa.bool_()), pa.array(errors, pa.list_(pa.string())), pa.array(texts, pa.string())], schema=schema)


def _places(nodes: DataFrame, needs: DataFrame) -> DataFrame:
    """(node, position, hops) of nodes (node, turn) given needs (node, of); a null position marks members of, or those behind, a cycle."""
    placed = nodes.select("node", "turn", F.col("turn").alias("position"), F.lit(0).cast("long").alias("hops"))
    needs = needs.distinct()
    steps = 0
    while True:
        behind = needs.join(placed.select(F.col("node").alias("of"), "position", "hops"), "of").groupBy("node").agg(F.max(F.struct("position", (F.col("hops") + 1).alias("hops"))).alias("least"))
        own = F.struct("position", "hops")
        moved = placed.join(behind, "node", "left").withColumn("to", F.coalesce(F.greatest(own, F.col("least")), own))
        new = written(moved.select("node", "turn", F.col("to.position").alias("position"), F.col("to.hops").alias("hops"), (F.col("to") != own).alias("moves")), "places")
        found = new.agg(F.count_if("moves"), F.count_if(F.col("hops") > 0)).first()
        if not found[0]:
            return new.select("node", "position", "hops")
        steps += 1
        placed = new.drop("moves")
        if steps > found[1]:  # a chain of waits isn't longer than those that wait: what moves is in a cycle or behind one
            break
    lost, before = new.where("moves").select("node"), 0
    while True:
        lost = written(lost.union(needs.join(lost.select(F.col("node").alias("of")), "of").select("node")).distinct(), "lost")
        if before == (before := lost.count()):
            break
    lost = lost.withColumn("lost", F.lit(True))
    keep = F.col("lost").isNull()
    return placed.join(lost, "node", "left").select("node", F.when(keep, F.col("position")).alias("position"), F.when(keep, F.col("hops")).alias("hops"))


def link(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """`messages` with status (message, linked, unanswered, orphan, duplicate or cycle), position, hops, valid, errors and json."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    rows = messages.select("conv_id", F.coalesce("turn", F.lit(0)).cast("long").alias("turn"), "role", "text", "call_id", "tool", "arguments", "depends_on")
    rows = written(
        rows.withColumn("is_call", F.col("tool").isNotNull()).withColumn("is_result", F.col("call_id").isNotNull() & ~F.col("is_call")).withColumn("tie", F.xxhash64("role", "text", "arguments")).withColumn("row", F.monotonically_increasing_id()), "messages"
    )
    keyed = "conv_id is not null and call_id is not null"
    ordinal = F.struct("turn", "tie", "row", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"))
    calls = rows.where("is_call").where(keyed).groupBy("conv_id", "call_id").agg(F.min(ordinal).alias("call"))
    results = rows.where("is_result").where(keyed).groupBy("conv_id", "call_id").agg(F.min(ordinal).alias("result"))
    pairs = written(calls.join(results, ["conv_id", "call_id"], "full"), "linked")
    name = lambda kind, ident="call_id": F.to_json(F.struct(F.lit(kind).alias("k"), F.col("conv_id").alias("c"), F.col(ident).alias("i")))
    nodes = pairs.select(F.explode(F.array(F.struct(name("call").alias("node"), F.col("call.turn").alias("turn")), F.struct(name("result").alias("node"), F.col("result.turn").alias("turn")))).alias("x")).select("x.node", "x.turn").where("turn is not null")
    answers = pairs.where("call is not null and result is not null").select(name("result").alias("node"), name("call").alias("of"))
    waits = pairs.where("call is not null").select("conv_id", name("call").alias("node"), F.explode(F.array_distinct("call.depends_on")).alias("on")).select("node", name("result", "on").alias("of"))
    places = _places(nodes, answers.union(waits))
    known = pairs.select("conv_id", "call_id", F.col("call.row").alias("call_row"), F.col("result.row").alias("result_row"))
    # rows without a key join nothing: they stay out of joins, where they would be one hot key
    alone = rows.where(f"not ({keyed})").select(*rows.columns, F.lit(None).cast("long").alias("call_row"), F.lit(None).cast("long").alias("result_row"))
    out = rows.where(keyed).join(known, ["conv_id", "call_id"]).select(*rows.columns, "call_row", "result_row").unionByName(alone)
    kind = F.when(F.col("is_call"), F.lit("call")).when(F.col("is_result"), F.lit("result"))
    out = out.withColumn("node", F.when((F.col("row") == F.col("call_row")) | (F.col("row") == F.col("result_row")), F.when(kind == "call", name("call")).otherwise(name("result"))))
    status = (
        F.when(~F.col("is_call") & ~F.col("is_result"), "message")
        .when(F.col("is_call") & (F.col("row") != F.col("call_row")), "duplicate")
        .when(F.col("is_result") & (F.col("row") != F.col("result_row")), "duplicate")
        .when(F.col("call_row").isNotNull() & F.col("result_row").isNotNull(), "linked")
        .when(F.col("is_call"), "unanswered")
        .otherwise("orphan")
    )
    out = out.withColumn("status", status)
    nowhere = out.where("node is null").select(*out.columns, *(F.lit(None).cast("long").alias(c) for c in ("position", "hops")))
    placed = out.where("node is not null").join(places, "node").select(*out.columns, "position", "hops").unionByName(nowhere)
    lost = F.col("node").isNotNull() & F.col("position").isNull()
    placed = placed.select(
        "conv_id", "turn", "role", "text", "call_id", "tool", "arguments", "depends_on", "is_call",
        F.when(lost, "cycle").otherwise(F.col("status")).alias("status"),
        F.when(F.col("node").isNull(), F.col("turn")).otherwise(F.col("position")).alias("position"),
        F.when(F.col("node").isNull(), F.lit(0).cast("long")).otherwise(F.col("hops")).alias("hops"),
    )
    schema = StructType([*placed.schema.fields, *_parse_datatype_string(_CHECKED).fields])
    arrow = to_arrow_schema(schema)
    return placed.mapInArrow(lambda it: _serialised(it, schemas, arrow), schema).drop("is_call")


#: The tool that op8's calls use.
ASK = {"ask": {"type": "object", "properties": {"query": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}, "required": ["query", "turn"], "additionalProperties": False}}


def from_conversations(conversations: DataFrame) -> DataFrame:
    """Messages of plain conversations: a user turn calls tool `ask`, the assistant's next turn is its result. Every other call
    waits for the answer to the call after it, so that it must be moved; the calls in between wait for the one before the last."""
    ident = lambda turn: F.concat_ws("-", F.lit("call"), F.col("conv_id").cast("string"), turn.cast("string"))
    user, assistant, turn = F.col("role") == "user", F.col("role") == "assistant", F.col("turn")
    early = F.floor(turn / 2) % 2 == 0
    return conversations.select(
        "conv_id",
        "turn",
        F.when(assistant, "tool").otherwise(F.col("role")).alias("role"),
        F.when(~user | user.isNull(), F.col("text")).alias("text"),
        F.when(user, ident(turn)).when(assistant, ident(turn - 1)).alias("call_id"),
        F.when(user, "ask").alias("tool"),
        F.when(user, F.to_json(F.struct(F.col("text").alias("query"), turn.alias("turn")))).alias("arguments"),
        F.when(user & early, F.array(ident(turn + 2))).when(user & (turn >= 4), F.array(ident(turn - 4))).alias("depends_on"),
    )


def op8_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of every conversation as a linked, placed, validated message in canonical JSON."""
    linked = link(from_conversations(table(spark, sf_dir, "conversations")), ASK)
    return linked.select("conv_id", "turn", "call_id", "status", "position", "hops", "valid", F.array_join("errors", "; ").alias("errors"), "json")


#: The same in DuckDB, for conversations whose turns occur once.
OP8_SQL = """
with m as (select *, role = 'user' as u, role = 'assistant' as a from conversations),
t as (select m.*, floor(m.turn / 2)::bigint % 2 = 0 as early,
 exists (select 1 from m o where o.conv_id = m.conv_id and o.a and o.turn = m.turn + 1) as answered,
 exists (select 1 from m o where o.conv_id = m.conv_id and o.u and o.turn = m.turn - 1) as called,
 exists (select 1 from m o where o.conv_id = m.conv_id and o.a and o.turn = m.turn + 3) as three,
 exists (select 1 from m o where o.conv_id = m.conv_id and o.a and o.turn = m.turn + 2) as two from m),
c as (select *, case when u and early and three then 1 when a and called and floor((turn - 1) / 2)::bigint % 2 = 0 and two then 2 else 0 end as hops,
 case when u then 'call-' || conv_id || '-' || turn when a then 'call-' || conv_id || '-' || (turn - 1) end as call_id,
 case when u and early then 'call-' || conv_id || '-' || (turn + 2) when u and turn >= 4 then 'call-' || conv_id || '-' || (turn - 4) end as waits,
 case when u and text is null then '$.query: required' when u and text = '' then '$.query: minLength' else '' end as errors from t)
select conv_id, turn, call_id, case when u then case when answered then 'linked' else 'unanswered' end when a then case when called then 'linked' else 'orphan' end else 'message' end as status,
 turn + case hops when 1 then 3 when 2 then 2 else 0 end as position, hops::bigint as hops, case when u then errors = '' end as valid, errors,
 '{"content":' || case when u or text is null then 'null' else to_json(text)::varchar end || ',"role":' || case when a then '"tool"' else to_json(role)::varchar end
 || case when u then ',"tool_call":{"arguments":{' || case when text is null then '' else '"query":' || to_json(text)::varchar || ',' end || '"turn":' || turn || '},' || case when waits is null then '' else '"depends_on":["' || waits || '"],' end
 || '"id":"' || call_id || '","name":"ask"}' when a then ',"tool_call_id":"' || call_id || '"' else '' end || '}' as json from c"""
