"""Chat formatting with linked tool calls.

Messages are parsed once. Calls and results are exploded and hash-joined by (conversation, call
identifier); a topological level puts every call after the results that its arguments name and
every result after its call; arguments are validated against the tool schemas that the
conversation declares; each message is serialised as canonical JSON (sorted keys, no blanks).
Rows stay one per message, so a conversation of any length is never gathered in one task.

Conventions: <tools>[...]</tools> in any message declares {"name", "parameters"} (a JSON schema,
also inside {"function": ...}); <tool_call>{"id", "name", "arguments"}</tool_call> is a call; a
message of role `tool`, or <tool_result>...</tool_result>, is a result {"tool_call_id", "content"}.
An argument {"$ref": id} stands for the result of that call.
"""

from __future__ import annotations

import datetime
import ipaddress
import json
import re
import urllib.parse
import uuid
from fractions import Fraction

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, keep, shared_dir, written

CALL = "struct<k:int,id:string,name:string,args:string,refs:array<string>>"
RESULT = "struct<k:int,id:string,content:string>"
PARSED = f"conv_id long, turn long, role string, content string, calls array<{CALL}>, results array<{RESULT}>, tools array<struct<name:string,spec:string>>, broken int"
_TAG = re.compile(r"<(tool_call|tool_result|tools)>(.*?)</\1>", re.S)


_LONE = re.compile("[\ud800-\udfff]")


def plain(text: str) -> str:
    """Halves of surrogate pairs, which no UTF-8 can hold, as their JSON escapes."""
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value) -> str:
    return plain(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _json(text: str):
    """The value of a JSON text that can be written again; None for any other: NaN, infinite numbers, numbers of
    over 4300 digits and nesting that the parser does not follow are no JSON here."""
    try:
        value = json.loads(text, parse_constant=_refuse)
        canonical(value)
        return value
    except (ValueError, RecursionError):
        return None


def _refuse(name: str):
    raise ValueError(name)


def refs(value) -> list[str]:
    """Call identifiers that an argument value refers to, sorted."""
    found, todo = set(), [value]
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            if set(v) == {"$ref"} and isinstance(v["$ref"], str):
                found.add(plain(v["$ref"]))
            todo += v.values()
        elif isinstance(v, list):
            todo += v
    return sorted(found)


def parse(role: str | None, text: str | None) -> dict:
    """One message: its content without the tool blocks, and these. A block that cannot be read stays in
    the content and counts as broken."""
    out: dict = {"calls": [], "results": [], "tools": [], "broken": 0}

    def take(m) -> str:
        v = _json(m[2])
        if m[1] == "tools" and isinstance(v, list) and all(isinstance(t, dict) for t in v):
            for t in v:
                t = t["function"] if isinstance(t.get("function"), dict) else t
                out["tools"].append({"name": plain(str(t.get("name"))), "spec": canonical(t.get("parameters", {}))})
            return ""
        if m[1] == "tool_call" and isinstance(v, dict) and isinstance(v.get("name"), str):
            args = v.get("arguments", {})
            args = _json(args) if isinstance(args, str) else args  # arguments that cannot be read are null
            out["calls"].append({"k": len(out["calls"]), "id": None if v.get("id") is None else plain(str(v["id"])), "name": plain(v["name"]), "args": canonical(args), "refs": refs(args)})
            return ""
        if m[1] == "tool_result" and isinstance(v, dict) and v.get("tool_call_id") is not None:
            out["results"].append({"k": len(out["results"]), "id": plain(str(v["tool_call_id"])), "content": canonical(v.get("content"))})
            return ""
        out["broken"] += 1
        return m[0]

    text = text or ""
    whole = _json(text) if role == "tool" and "<tool_result>" not in text else None
    if isinstance(whole, dict) and whole.get("tool_call_id") is not None:
        out["results"].append({"k": 0, "id": plain(str(whole["tool_call_id"])), "content": canonical(whole.get("content"))})
        text = ""
    else:
        text = _TAG.sub(take, text)
    return out | {"content": text}


_ONE = {"additionalProperties", "items", "not", "contains", "propertyNames", "if", "then", "else"}
_LIST = {"anyOf", "oneOf", "allOf", "prefixItems"}
_NAMED = {"properties", "patternProperties", "$defs", "definitions", "dependentSchemas"}
_PLAIN = {"type", "enum", "const", "required", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minLength", "maxLength", "pattern", "format", "minItems", "maxItems", "uniqueItems", "minContains", "maxContains", "minProperties", "maxProperties", "dependentRequired", "$ref"}
_NOTES = {"title", "description", "default", "examples", "deprecated", "readOnly", "writeOnly", "$schema", "$comment"}


def _date_time(v: str) -> bool:
    return re.fullmatch(r"\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)", v, re.ASCII) is not None and datetime.datetime.fromisoformat(v.upper()) is not None


FORMATS = {
    "date": lambda v: re.fullmatch(r"\d{4}-\d\d-\d\d", v, re.ASCII) is not None and datetime.date.fromisoformat(v) is not None,
    "date-time": _date_time,
    "time": lambda v: _date_time("2000-01-01T" + v),
    "email": lambda v: re.fullmatch(r"[^@\s]+@[^@\s]+", v) is not None,
    "ipv4": lambda v: ipaddress.IPv4Address(v) is not None,
    "ipv6": lambda v: "%" not in v and ipaddress.IPv6Address(v) is not None,
    "uri": lambda v: re.fullmatch(r"[A-Za-z][A-Za-z0-9+.-]*:[!-~]*", v) is not None,
    "uuid": lambda v: re.fullmatch(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}", v) is not None,
}


def supported(spec) -> bool:
    """Whether valid() knows all keywords, types and formats of a schema and of the schemas in it."""
    if isinstance(spec, bool):
        return True
    if not isinstance(spec, dict) or set(spec) - _ONE - _LIST - _NAMED - _PLAIN - _NOTES or spec.get("format", "date") not in FORMATS or not str(spec.get("$ref", "#")).startswith("#"):
        return False
    inner = [spec[k] for k in _ONE if k in spec] + [x for k in _LIST for x in spec.get(k, [])] + [x for k in _NAMED for x in spec.get(k, {}).values()]
    return all(map(supported, inner))


def _same(a, b) -> bool:
    """Equality of JSON: 1 is 1.0, but not true."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(v, b[k]) for k, v in a.items())
    return a == b


def _frozen(value):
    """Equal for JSON values that are equal, and hashable."""
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return type(value).__name__, value
    if isinstance(value, list):
        return "list", tuple(map(_frozen, value))
    if isinstance(value, dict):
        return "dict", frozenset((k, _frozen(v)) for k, v in value.items())
    return "number", value


#: Seconds that a declared pattern may take with one string; beyond, its schema cannot be judged.
PATTERN_SECONDS = 2.0


def _search(pattern: str, text: str) -> bool:
    return regex.search(pattern, text, timeout=PATTERN_SECONDS) is not None


def _format(name: str, value: str) -> bool:
    try:
        return FORMATS[name](value)
    except ValueError:
        return False


def _target(root, ref: str):
    at = root
    for part in ref[1:].split("/")[1:]:
        part = urllib.parse.unquote(part).replace("~1", "/").replace("~0", "~")
        at = at[int(part)] if isinstance(at, list) else at[part]
    if ref[1:2] not in ("", "/") or not supported(at):
        raise KeyError(ref)
    return at


def valid(value, spec) -> bool | None:
    """JSON-schema check, of local references too; None where the schema cannot be judged: a keyword, type,
    format or reference that is not known, a malformed one, or a pattern that takes too long. A {"$ref"}
    argument fits any schema."""
    try:
        return _fits(value, spec, spec) if supported(spec) else None
    except (ArithmeticError, AttributeError, LookupError, RecursionError, TimeoutError, TypeError, ValueError, regex.error):
        return None


def _fits(value, spec, root) -> bool:
    if isinstance(spec, bool) or (isinstance(value, dict) and set(value) == {"$ref"}):
        return spec is not False
    kinds = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
    fits = lambda v, s: _fits(v, s, root)
    number = isinstance(value, (int, float)) and not isinstance(value, bool)

    def is_a(t: str) -> bool:
        if t in ("integer", "number"):
            return number and (t == "number" or isinstance(value, int) or value.is_integer())
        return isinstance(value, kinds[t])

    types = spec.get("type", [])
    types = [types] if isinstance(types, str) else types
    if types and not any([is_a(t) for t in types]) or "enum" in spec and not any(_same(value, x) for x in spec["enum"]) or "const" in spec and not _same(value, spec["const"]):
        return False
    if "$ref" in spec and not fits(value, _target(root, spec["$ref"])):
        return False
    if not all([fits(value, s) for s in spec.get("allOf", [])]) or "anyOf" in spec and not any([fits(value, s) for s in spec["anyOf"]]):
        return False
    if "oneOf" in spec and sum(fits(value, s) for s in spec["oneOf"]) != 1 or "not" in spec and fits(value, spec["not"]):
        return False
    if "if" in spec and not fits(value, spec.get("then" if fits(value, spec["if"]) else "else", True)):
        return False
    if isinstance(value, dict):
        props, patterns = spec.get("properties", {}), spec.get("patternProperties", {})
        for k, v in value.items():
            own = [props[k]] if k in props else []
            own += [s for p, s in patterns.items() if _search(p, k)]
            if not all([fits(v, s) for s in own or [spec.get("additionalProperties", True)]]) or not fits(k, spec.get("propertyNames", True)):
                return False
        if not all(k in value for k in spec.get("required", [])) or not spec.get("minProperties", 0) <= len(value) <= spec.get("maxProperties", len(value)):
            return False
        return all(n in value for k, names in spec.get("dependentRequired", {}).items() if k in value for n in names) and all([fits(value, s) for k, s in spec.get("dependentSchemas", {}).items() if k in value])
    if isinstance(value, list):
        first, more = spec.get("prefixItems", []), spec.get("items", True)
        if not spec.get("minItems", 0) <= len(value) <= spec.get("maxItems", len(value)) or not all([fits(v, first[i] if i < len(first) else more) for i, v in enumerate(value)]):
            return False
        if spec.get("uniqueItems") and len(set(map(_frozen, value))) < len(value):
            return False
        n = sum(fits(v, spec["contains"]) for v in value) if "contains" in spec else 0
        return "contains" not in spec or spec.get("minContains", 1) <= n <= spec.get("maxContains", n)
    if isinstance(value, str):
        return spec.get("minLength", 0) <= len(value) <= spec.get("maxLength", len(value)) and ("pattern" not in spec or _search(spec["pattern"], value)) and ("format" not in spec or _format(spec["format"], value))
    if number:
        within = spec.get("minimum", value) <= value <= spec.get("maximum", value) and ("exclusiveMinimum" not in spec or value > spec["exclusiveMinimum"]) and ("exclusiveMaximum" not in spec or value < spec["exclusiveMaximum"])
        return within and ("multipleOf" not in spec or Fraction(str(value)) % Fraction(str(spec["multipleOf"])) == 0)
    return True


def parsed(conversations: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = [{"conv_id": c, "turn": t, "role": r, **parse(r, x)} for c, t, r, x in zip(*(col.to_pylist() for col in batch.columns))]
            yield pa.RecordBatch.from_pylist(rows, schema=_arrow())

    return bounded(conversations).select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")).mapInArrow(run, PARSED)


def _arrow() -> pa.Schema:
    s, i = pa.string(), pa.int32()
    call = pa.struct([("k", i), ("id", s), ("name", s), ("args", s), ("refs", pa.list_(s))])
    return pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", s), ("content", s), ("calls", pa.list_(call)), ("results", pa.list_(pa.struct([("k", i), ("id", s), ("content", s)]))), ("tools", pa.list_(pa.struct([("name", s), ("spec", s)]))), ("broken", i)])


def levels(calls: DataFrame) -> DataFrame:
    """calls(conv_id, id, refs, at) -> conv_id, id, level, cyclic. The level of a call is its turn, or one past
    the highest level among the calls that its arguments refer to, whichever is larger. Calls on a
    cycle, or behind one, keep their turn and are marked. conv_id is not null.

    Each round settles the calls whose references are settled and takes these references off the edges; what
    is settled is appended to one written table, so neither plans nor rounds grow with the depth.
    """
    spark = calls.sparkSession
    own = written(calls.groupBy("conv_id", "id").agg(F.min("at").alias("at")))
    edges = calls.select("conv_id", "id", F.explode("refs").alias("ref")).distinct()
    edges = written(edges.join(own.select("conv_id", F.col("id").alias("ref")), ["conv_id", "ref"], "left_semi"))  # a call that is not there holds nothing up
    held = edges.select("conv_id", "id").distinct()
    folder = f"{shared_dir(spark)}/levels-{uuid.uuid4().hex}"
    ready = own.join(held, ["conv_id", "id"], "left_anti").select("conv_id", "id", F.col("at").alias("level"))
    rest = written(own.join(held, ["conv_id", "id"], "left_semi").withColumn("level", F.col("at")))
    k = 0
    while True:
        ready.select("*", F.lit(False).alias("cyclic")).write.parquet(f"{folder}/round={k}")
        last = spark.read.parquet(f"{folder}/round={k}")
        if last.isEmpty() or edges.isEmpty():
            break
        got = edges.join(last.select("conv_id", F.col("id").alias("ref"), F.col("level").alias("l")), ["conv_id", "ref"])
        past = got.groupBy("conv_id", "id").agg((F.max("l") + 1).alias("past"))
        edges = written(edges.join(last.select("conv_id", F.col("id").alias("ref")), ["conv_id", "ref"], "left_anti"))
        rest = written(rest.join(past, ["conv_id", "id"], "left").select("conv_id", "id", "at", F.greatest("level", F.coalesce("past", "level")).alias("level")))
        open_ = edges.select("conv_id", "id").distinct()
        ready, rest = rest.join(open_, ["conv_id", "id"], "left_anti").select("conv_id", "id", "level"), rest.join(open_, ["conv_id", "id"], "left_semi")
        k += 1
    keep(spark, folder)
    done = spark.read.schema(last.schema).parquet(*[f"{folder}/round={i}" for i in range(k + 1)])
    return done.union(rest.select("conv_id", "id", F.col("at").alias("level"), F.lit(True)))


def format_chat(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, position, role, n_calls, n_linked, n_valid, n_results, n_orphans, n_broken, message for each row of
    conversations(conv_id, turn, role, text); ordering by conv_id, position, turn is a topological order.

    n_linked counts calls that a result answers, n_valid calls whose tool is declared once and
    whose arguments fit (where the schema cannot be judged, the message says valid: null); n_orphans counts results without a call. Of calls with one identifier in
    a conversation, the first (by turn, then place) owns the results. A null text is empty, null ids
    and turns are values like others, a call without identifier is never linked. Rows that repeat are
    formatted each; other columns are ignored.
    """
    base = written(parsed(conversations).withColumn("row", F.monotonically_increasing_id()))
    call = base.select("row", "conv_id", "turn", F.explode("calls").alias("c")).select("row", "conv_id", "turn", "c.*")
    result = base.select("row", "conv_id", "turn", F.explode("results").alias("r")).select("row", "conv_id", "turn", "r.*")
    tool = base.select("conv_id", F.explode("tools").alias("t")).select("conv_id", "t.*").distinct()
    tool = tool.groupBy("conv_id", "name").agg(F.min("spec").alias("spec"), F.count("*").alias("n"))
    owner = call.where("id is not null").groupBy("conv_id", "id").agg(F.min(F.struct("turn", "row", "k")).alias("owner"))
    answer = result.groupBy("conv_id", "id").agg(F.min(F.struct("turn", "row", "k", "content")).alias("answer"))

    linked = call.join(owner.withColumnRenamed("conv_id", "o_conv").withColumnRenamed("id", "o_id"), F.col("conv_id").eqNullSafe(F.col("o_conv")) & (F.col("id") == F.col("o_id")), "left")
    linked = linked.join(answer.withColumnRenamed("conv_id", "a_conv").withColumnRenamed("id", "a_id"), F.col("conv_id").eqNullSafe(F.col("a_conv")) & (F.col("id") == F.col("a_id")), "left")
    linked = linked.join(tool.select(F.col("conv_id").alias("t_conv"), F.col("name").alias("t_name"), "spec", "n"), F.col("conv_id").eqNullSafe(F.col("t_conv")) & (F.col("name") == F.col("t_name")), "left")

    @F.pandas_udf("boolean")
    def check(args, spec, n):
        return pd.Series([valid(json.loads(a), json.loads(s)) if k == 1 and s is not None else False for a, s, k in zip(args, spec, n)], dtype=object)

    owns = F.col("owner").isNotNull() & (F.col("owner.row") == F.col("row")) & (F.col("owner.k") == F.col("k"))
    linked = linked.select("row", "k", "id", "name", "args", check("args", "spec", F.coalesce("n", F.lit(0))).alias("valid"), F.when(owns, F.col("answer.turn")).alias("answered"), (owns & F.col("answer").isNotNull()).alias("linked"))
    per_call = linked.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("k", "id", "name", "args", "valid", "linked", "answered"))).alias("calls_"))

    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit("none")).alias("conv_id")  # none: no number
    lv = written(levels(call.where("id is not null").select(conv, "id", "refs", F.coalesce("turn", F.lit(0)).alias("at"))))
    at_call = call.join(lv.select(F.col("conv_id").alias("l_conv"), F.col("id").alias("l_id"), "level"), (conv == F.col("l_conv")) & (F.col("id") == F.col("l_id"))).select("row", "level")
    at_result = result.join(lv.select(F.col("conv_id").alias("l_conv"), F.col("id").alias("l_id"), "level"), (conv == F.col("l_conv")) & (F.col("id") == F.col("l_id"))).select("row", (F.col("level") + 1).alias("level"))
    position = at_call.union(at_result).groupBy("row").agg(F.max("level").alias("level"))
    orphan = result.join(owner.withColumnRenamed("conv_id", "o_conv").withColumnRenamed("id", "o_id"), F.col("conv_id").eqNullSafe(F.col("o_conv")) & (F.col("id") == F.col("o_id")), "left")
    per_result = orphan.groupBy("row").agg(F.count_if(F.col("owner").isNull()).alias("orphans"), F.sort_array(F.collect_list(F.struct("k", "id", "content", F.col("owner").isNotNull().alias("linked")))).alias("results_"))

    @F.pandas_udf("string")
    def message(role, content, calls, results):
        out = []
        for r, c, cs, rs in zip(role, content, calls, results):
            m: dict = {"role": r, "content": c}
            if cs is not None:
                m["tool_calls"] = [{"id": x["id"], "name": x["name"], "arguments": json.loads(x["args"]), "valid": x["valid"], "linked": bool(x["linked"])} for x in cs]
            if rs is not None:
                m["tool_results"] = [{"tool_call_id": x["id"], "content": json.loads(x["content"]), "linked": bool(x["linked"])} for x in rs]
            out.append(canonical(m))
        return pd.Series(out, dtype=object)

    count = lambda what: F.coalesce(F.size(F.filter("calls_", lambda x: x[what])), F.lit(0)).cast("long")
    df = base.select("row", "conv_id", "turn", "role", "content", "broken").join(per_call, "row", "left").join(per_result, "row", "left").join(position, "row", "left")
    return df.select(
        "conv_id", "turn", F.greatest(F.col("turn"), F.col("level")).alias("position"), "role",
        F.when(F.col("calls_").isNull(), 0).otherwise(F.size("calls_")).cast("long").alias("n_calls"), F.when(F.col("calls_").isNull(), F.lit(0)).otherwise(count("linked")).alias("n_linked"), F.when(F.col("calls_").isNull(), F.lit(0)).otherwise(count("valid")).alias("n_valid"),
        F.when(F.col("results_").isNull(), 0).otherwise(F.size("results_")).cast("long").alias("n_results"), F.coalesce("orphans", F.lit(0)).alias("n_orphans"), F.col("broken").cast("long").alias("n_broken"),
        message("role", "content", "calls_", "results_").alias("message"),
    )
