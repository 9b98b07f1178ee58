"""Tool calls of conversations: linked to results, checked, ordered, as canonical JSON."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cargolens.llm.storage import process_value, written

OPEN, CLOSE = "<tool_call>", "</tool_call>"
TYPES = {
    "object": dict, "array": list, "string": str, "boolean": bool, "null": type(None),
}
ITEM = ("turn long, position int, kind string, call_id string, name string, valid boolean, "
        "error string, after array<string>, json string")
SURROGATE = "[\ud800-\udfff]"


class Malformed(ValueError):
    pass


def _unique(pairs):
    found = dict(pairs)
    if len(found) < len(pairs):
        raise Malformed("repeated key")
    return found


def _no_constant(name):
    raise Malformed(name)


def _decoder() -> json.JSONDecoder:
    return json.JSONDecoder(object_pairs_hook=_unique, parse_constant=_no_constant)


def _plain(value):
    """Whole floats as integers, so that equal numbers are written alike."""
    if isinstance(value, float):
        if not math.isfinite(value):
            raise Malformed("number out of range")
        return int(value) if value.is_integer() and abs(value) < 2**53 else value
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return value


def canonical(value) -> str:
    """JSON with sorted keys and no spaces; characters are not escaped unless JSON asks for it."""
    try:
        text = json.dumps(_plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except RecursionError:
        raise Malformed("nested too deeply") from None
    if re.search(SURROGATE, text):
        raise Malformed("lone surrogate")
    return text


def parse(text: str, at: int = 0):
    """A JSON value and where it ends; ``Malformed`` for anything else."""
    try:
        while text[at : at + 1].isspace():
            at += 1
        return process_value("json_decoder", _decoder).raw_decode(text, at)
    except (ValueError, RecursionError) as error:
        raise Malformed(str(error)) from None


def problems(value, schema: dict, path: str = "$") -> Iterator[str]:
    """Where a value breaks a schema: types, enums, required and further properties, bounds."""
    kind = schema.get("type")
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    # Integers stay integers: one of hundreds of digits fits no float.
    whole = number and (isinstance(value, int) or value.is_integer())
    fits = {"number": number, "integer": whole}.get(kind, isinstance(value, TYPES.get(kind, object)))
    if not fits:
        yield f"{path}: not {kind}"
        return
    if "enum" in schema and value not in schema["enum"]:
        yield f"{path}: not one of the allowed values"
    if number and (value < schema.get("minimum", value) or value > schema.get("maximum", value)):
        yield f"{path}: out of range"
    if isinstance(value, str) and not (
        schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value))
    ):
        yield f"{path}: length out of range"
    if isinstance(value, list) and "items" in schema:
        for k, item in enumerate(value):
            yield from problems(item, schema["items"], f"{path}[{k}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for name in schema.get("required", []):
            if name not in value:
                yield f"{path}.{name}: missing"
        for name in sorted(value):
            if name in known:
                yield from problems(value[name], known[name], f"{path}.{name}")
            elif schema.get("additionalProperties", True) is False:
                yield f"{path}.{name}: not known"


def _call(value, schemas: dict) -> tuple:
    """``kind, call_id, name, valid, error, after, json`` of a parsed call."""
    if not isinstance(value, dict) or not isinstance(value.get("id"), str):
        raise Malformed("no identifier")
    after = value.get("after") or []
    if not isinstance(after, list) or not all(isinstance(x, str) for x in after):
        raise Malformed("after is no list of identifiers")
    name, text = value.get("name"), canonical(value)
    if not isinstance(name, str) or name not in schemas:
        error = "unknown tool"
    else:
        error = next(problems(value.get("arguments", {}), schemas[name]), None)
    name = name if isinstance(name, str) else None
    return "call", value["id"], name, error is None, error, sorted(set(after)), text


def items_of(role: str | None, text: str | None, schemas: dict) -> list[tuple]:
    """The calls, result or plain text of one message, in order."""
    text = text or ""
    if role == "tool":
        try:
            value, end = parse(text)
            if text[end:].strip() or not isinstance(value, dict):
                raise Malformed("no single object")
            if not isinstance(value.get("tool_call_id"), str):
                raise Malformed("no identifier")
            return [("result", value["tool_call_id"], None, True, None, [], canonical(value))]
        except Malformed:
            return [("result", None, None, False, "malformed", [],
                     canonical({"content": text, "role": "tool"}))]
    found, rest, at = [], [], 0
    while role == "assistant" and (start := text.find(OPEN, at)) >= 0:
        rest.append(text[at:start])
        start += len(OPEN)
        try:
            value, at = parse(text, start)
            found.append(_call(value, schemas))
        except (Malformed, RecursionError):
            close = text.find(CLOSE, start)
            at = len(text) if close < 0 else close
            raw = canonical({"content": text[start:at], "role": "assistant"})
            found.append(("call", None, None, False, "malformed", [], raw))
        if text[at:].lstrip().startswith(CLOSE):
            at = text.index(CLOSE, at) + len(CLOSE)
    rest.append(text[at:])
    plain = "".join(rest)
    if plain.strip() or not found:
        content = canonical({"content": plain, "role": role})
        found.insert(0, ("text", None, None, True, None, [], content))
    return found


def _items(rows: DataFrame, schemas: dict) -> DataFrame:
    conv_type = rows.schema["conv_id"].dataType.simpleString()
    names = ["turn", "position", "kind", "call_id", "name", "valid", "error", "after", "json"]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(),
             pa.string(), pa.list_(pa.string()), pa.string()]

    def run(batches):
        for batch in batches:
            own, out = [], []
            turns, roles, texts = (batch.column(k).to_pylist() for k in (1, 2, 3))
            for k, (turn, role, text) in enumerate(zip(turns, roles, texts, strict=True)):
                for position, item in enumerate(items_of(role, text, schemas)):
                    own.append(k)
                    out.append((turn, position, *item))
            columns = list(zip(*out, strict=True)) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(own, pa.int64())),
                 *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["conv_id", *names],
            )

    return rows.mapInArrow(run, f"conv_id {conv_type}, {ITEM}")


def _same(left: DataFrame, right: DataFrame, **names: str) -> Column:
    """Null-safe equality, so that messages without a conversation are one."""
    found = F.lit(True)
    for a, b in names.items():
        found = found & left[a].eqNullSafe(right[b])
    return found


def _chain_ends(links: DataFrame) -> DataFrame:
    """``conv, id, end, hops``: where chains of calls that wait for one other each lead.

    Every round doubles the hops of all links. Those that still lead to a link after as many
    rounds as their number has binary digits go round in circles and are left out.
    """
    links = written(links, "hops")
    for _ in range(links.count().bit_length() + 1):
        onward = links.toDF("c", "i", "next", "more")
        joined = links.join(onward, _same(links, onward, conv="c", end="i"), "left")
        moved = written(
            joined.select(
                "conv", "id", F.coalesce("next", "end").alias("end"),
                (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"),
                F.col("i").isNotNull().alias("moved"),
            ),
            "hops",
        )
        if moved.filter("moved").isEmpty():
            return links
        links = moved.drop("moved")
    starts = links.select(F.col("conv").alias("c"), F.col("id").alias("i"))
    return written(links.join(starts, _same(links, starts, conv="c", end="i"), "left_anti"), "hops")


def dependency_depths(calls: DataFrame) -> DataFrame:
    """``conv, id, depth`` of calls: 0 for those that wait for none, else one more than the
    deepest they wait for. Calls in or behind a cycle are left out.

    ``calls`` has ``conv, id, after``, one row per call. Identifiers that name no call of the
    conversation are ignored. Chains of calls that wait for one other each are first shortened
    to one link, in as many rounds as their length has binary digits. Then every round settles
    the calls of several dependencies whose last one was settled before, and reads only what is
    still open.
    """
    waits = calls.select("conv", "id", F.explode("after").alias("dep"))
    known = calls.select(F.col("conv").alias("c"), F.col("id").alias("i"))
    edges = written(
        waits.join(known, _same(waits, known, conv="c", dep="i")).select("conv", "id", "dep"),
        "waits",
    )
    waiting = written(
        edges.groupBy(F.col("conv").alias("c"), F.col("id").alias("i"))
        .agg(F.count("*").alias("n"), F.min("dep").alias("end")),
        "waiting",
    )
    settled = written(
        calls.join(waiting, _same(calls, waiting, conv="c", id="i"), "left_anti")
        .select("conv", "id", F.lit(0).cast("long").alias("depth")),
        "depth",
    )
    chains = _chain_ends(
        waiting.filter("n = 1").select(
            F.col("c").alias("conv"), F.col("i").alias("id"), "end",
            F.lit(1).cast("long").alias("hops"),
        )
    )
    several = waiting.filter("n > 1").select("c", "i")
    edges = edges.join(several, _same(edges, several, conv="c", id="i"), "left_semi")
    via = chains.toDF("c", "i", "end", "hops")
    edges = written(
        edges.join(via, _same(edges, via, conv="c", dep="i"), "left").select(
            "conv", "id", F.coalesce("end", "dep").alias("dep"),
            (F.coalesce("hops", F.lit(0)) + 1).alias("hops"),
        ),
        "waits",
    )
    while not edges.isEmpty():
        done = settled.toDF("c", "i", "depth")
        state = edges.join(done, _same(edges, done, conv="c", dep="i"), "left")
        ready = written(
            state.groupBy("conv", "id").agg(
                F.count("*").alias("all"), F.count("depth").alias("known"),
                F.max(F.col("depth") + F.col("hops")).alias("depth"),
            ).filter("all = known").select("conv", "id", "depth"),
            "ready",
        )
        if ready.isEmpty():
            break
        gone = ready.toDF("c", "i", "d")
        edges = written(edges.join(gone, _same(edges, gone, conv="c", id="i"), "left_anti"), "waits")
        settled = written(settled.union(ready), "depth")
    ends = settled.toDF("c", "i", "depth")
    linked = chains.join(ends, _same(chains, ends, conv="c", end="i")).select(
        "conv", "id", (F.col("depth") + F.col("hops")).alias("depth")
    )
    found = settled.union(linked).withColumn("depth", F.col("depth").cast("int"))
    return written(found, "depth")


def link_tool_calls(messages: DataFrame, schemas: dict, conv_column: str = "conv_id",
                    turn_column: str = "turn", role_column: str = "role",
                    text_column: str = "text") -> DataFrame:
    """``conv_id, turn, position, kind, call_id, name, level, status, valid, error, json``.

    Assistant messages hold calls, JSON objects between ``<tool_call>`` tags with ``id, name,
    arguments`` and identifiers ``after`` that they wait for. Messages of role ``tool`` are
    results, JSON objects with ``tool_call_id``. One row is returned per call and result, and
    one per message for its other text (kind ``text``).

    Within a conversation the first call and the first result of an identifier are linked by a
    hash join on both. ``status`` is ``linked`` or ``unanswered`` for calls, ``linked``,
    ``orphan`` (no call), ``early`` (before its call) for results, ``repeated`` for later ones of
    the same identifier, ``cyclic`` for calls that wait for themselves, ``malformed`` without an
    identifier, else null. Sorting by ``level, turn, position`` is a topological order: a call's
    level is twice its depth of dependencies and its result's is one more; other rows have none.
    ``valid`` and ``error`` tell whether the arguments fit the schema of the tool's name in
    ``schemas``. ``json`` is canonical: sorted keys, no spaces, whole numbers as integers.

    Null text counts as empty, null roles are plain text, null conversations are one. Rows that
    repeat are returned each. An empty table gives an empty result; other columns are ignored.
    """
    rows = messages.select(
        F.col(conv_column).alias("conv_id"), F.col(turn_column).cast("long").alias("turn"),
        F.col(role_column).alias("role"), F.col(text_column).alias("text"),
    )
    items = written(_items(rows, schemas), "items")
    place = F.struct("turn", "position")

    def first(kind, *more):
        chosen = items.filter((F.col("kind") == kind) & F.col("call_id").isNotNull())
        return chosen.groupBy(F.col("conv_id").alias("conv"), F.col("call_id").alias("id")).agg(
            F.min(place).alias(f"{kind}_at"), *more
        )

    calls = written(first("call", F.min_by("after", place).alias("after")), "calls")
    results = written(first("result"), "results")
    depths = dependency_depths(calls.select("conv", "id", "after")).toDF("c", "i", "depth")
    calls = calls.join(depths, _same(calls, depths, conv="c", id="i"), "left").select(
        "conv", "id", "call_at", "depth"
    )
    answered = results.toDF("c", "i", "result_at")
    linked = written(
        calls.join(answered, _same(calls, answered, conv="c", id="i"), "full").select(
            F.when(F.col("id").isNull(), F.col("c")).otherwise(F.col("conv")).alias("conv"),
            F.coalesce("id", "i").alias("id"), "call_at", "result_at", "depth",
        ),
        "linked",
    )
    found = items.join(linked, _same(items, linked, conv_id="conv", call_id="id"), "left")
    at, call, result = place, F.col("call_at"), F.col("result_at")
    of_call = (
        F.when(F.col("call_id").isNull(), "malformed").when(at != call, "repeated")
        .when(F.col("depth").isNull(), "cyclic").when(result > call, "linked")
        .otherwise("unanswered")
    )
    of_result = (
        F.when(F.col("call_id").isNull(), "malformed").when(call.isNull(), "orphan")
        .when(at != result, "repeated").when(result > call, "linked").otherwise("early")
    )
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    status = F.when(is_call, of_call).when(is_result, of_result)
    level = F.when(
        status.isin("linked", "unanswered"), 2 * F.col("depth") + F.when(is_result, 1).otherwise(0)
    )
    return found.select(
        "conv_id", "turn", "position", "kind", "call_id", "name", level.alias("level"),
        status.alias("status"), "valid", "error", "json",
    )
