"""Chat formatting with linked tool calls: hash-join calls and results by identifier, order them, check arguments, write canonical JSON. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stage

#: Members of a message with tool traffic: {"tool_calls": [{"id", "name", "arguments"}], "content"?} or {"tool_call_id", "content"}; a call may hold name and arguments in a member function.
MEMBERS, CALL_MEMBERS, FUNCTION_MEMBERS = ("content", "role", "tool_call_id", "tool_calls"), ("arguments", "function", "id", "name", "type"), ("arguments", "name")
#: Schema types.
TYPES = ("string", "integer", "number", "boolean", "object", "array")
MAP = "map<string,variant>"
PIECE = "struct<kind:int,pos:int,call_id:string,name:string,types:map<string,string>,is_object:boolean,head:string,tail:string>"


def json_text(c: Column) -> Column:
    """A JSON string literal: quotes, backslashes and control characters escaped; null for null."""
    return F.substring(F.to_json(F.array(c)), 2, 2_147_483_647).substr(F.lit(1), F.length(F.to_json(F.array(c))) - 2)


def _get(v: Column | str, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _type(v: Column) -> Column:
    """A variant's JSON type; a number without a fraction is an integer however it is written."""
    s = F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    x = _get(v, "$", "double")
    out = F.when(s == "STRING", "string").when(s.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.when(x == F.floor(x), "integer").otherwise("number")).when(s == "BOOLEAN", "boolean")
    return out.when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").otherwise("null")


def _more(members: Column) -> Column:
    ""","extra":{...} of members that have no place of their own, else nothing."""
    return F.when(F.size(members) > 0, F.concat(F.lit(',"extra":'), F.to_json(members))).otherwise("")


def _literal(c: Column) -> Column:
    return F.coalesce(json_text(c), F.lit("null"))


def _piece(kind: int, pos: Column, call_id: Column, name: Column, types: Column, is_object: Column, head: Column, tail: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), pos.cast("int").alias("pos"), call_id.alias("call_id"), name.alias("name"), types.alias("types"), is_object.alias("is_object"), head.alias("head"), tail.alias("tail")).cast(PIECE)


def _said(content: Column, more: Column) -> Column:
    none = F.lit(None)
    return _piece(0, F.lit(0), none, none, none, none, F.concat(F.lit('{"content":'), json_text(content), more, F.lit(',"role":')), F.lit("}"))


def _call(x: Column, pos: Column) -> Column:
    """A call's piece: name and arguments from it or its function; what else it holds is extra."""
    members, function = _get(x, "$", MAP), _get(x, "$.function", MAP)
    direct = F.map_contains_key(members, "name") | F.map_contains_key(members, "arguments")
    held = F.coalesce(_get(x, "$.arguments", "variant"), _get(x, "$.function.arguments", "variant"))
    held = F.coalesce(F.when(F.schema_of_variant(held) == "STRING", F.try_parse_json(_get(held, "$", "string"))), held)
    none = held.isNull() | F.is_variant_null(held)
    args = F.when(none, F.create_map().cast(MAP)).when(F.schema_of_variant(held).startswith("OBJECT"), _get(held, "$", MAP))
    spent = ~direct & function.isNotNull() & (F.size(F.array_except(F.map_keys(function), F.array(*map(F.lit, FUNCTION_MEMBERS)))) == 0)
    spent_type = F.coalesce(_get(x, "$.type", "string") == "function", F.lit(False))
    extra = F.map_filter(members, lambda k, v: ~k.isin(*CALL_MEMBERS) | (k == "function") & ~F.coalesce(spent, F.lit(False)) | (k == "type") & ~spent_type)
    call_id = F.nullif(F.trim(_get(x, "$.id", "string")), F.lit(""))
    name = F.coalesce(_get(x, "$.name", "string"), _get(x, "$.function.name", "string"))
    text = F.when(none, "{}").when(F.size(args) == 0, "{}").otherwise(F.to_json(held))
    head = F.concat(F.lit('{"arguments":'), text, _more(extra), F.lit(',"id":'), _literal(call_id), F.lit(',"name":'), _literal(name), F.lit(',"role":'))
    return _piece(1, pos, call_id, name, F.transform_values(args, lambda k, v: _type(v)), args.isNotNull(), head, F.lit("}"))


def parts(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, kind, pos, call_id, name, types, is_object, message): what messages hold, each parsed once: plain text (kind 0), calls (1) and results (2)."""
    m = messages.select("conv_id", "turn", F.coalesce(F.lower(F.trim("role")), F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    m = m.withColumn("v", F.when(F.col("text").rlike(r'^\s*\{[\s\S]*"tool_call'), F.try_parse_json("text")))
    m = m.withColumns({"all": _get("v", "$", MAP), "calls": _get("v", "$.tool_calls", "array<variant>"), "answers": F.nullif(F.trim(_get("v", "$.tool_call_id", "string")), F.lit(""))})
    calls = F.coalesce(F.col("calls"), F.array().cast("array<variant>"))
    absent = F.coalesce(F.schema_of_variant(F.try_element_at("all", F.lit("tool_calls"))), F.lit("VOID")) == "VOID"
    whole = (F.col("calls").isNotNull() | absent) & F.forall(calls, lambda x: F.coalesce(F.schema_of_variant(x).startswith("OBJECT"), F.lit(False)))
    tooled = F.col("all").isNotNull() & whole & ((F.size(calls) > 0) | F.col("answers").isNotNull())
    content = F.coalesce(_get("v", "$.content", "string"), F.lit(""))
    more = _more(F.map_filter("all", lambda k, v: ~k.isin(*MEMBERS)))
    none = F.lit(None)
    result = _piece(2, F.lit(0), F.col("answers"), none, none, none, F.concat(F.lit('{"content":'), json_text(content), more, F.lit(',"role":')), F.concat(F.lit(',"tool_call_id":'), json_text(F.col("answers")), F.lit("}")))
    own = F.when(F.col("answers").isNotNull(), F.array(result)).when((content != "") | (more != ""), F.array(_said(content, more))).otherwise(F.array().cast(f"array<{PIECE}>"))
    found = F.when(F.coalesce(tooled, F.lit(False)), F.concat(own, F.transform(calls, _call))).otherwise(F.array(_said(F.col("text"), F.lit(""))))
    p = m.select("conv_id", "turn", "role", F.explode(found).alias("p")).select("conv_id", "turn", "role", "p.*")
    return p.withColumn("message", F.concat("head", json_text(F.col("role")), "tail")).drop("head", "tail")


def link_chat(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row a message: (conv_id, turn, role, call_id, anchor_turn, step, pos, status, message) in canonical JSON.

    messages: (conv_id, turn, role, text). schemas: (name, param, type, required), one row a parameter; types are those
    of TYPES, and no value fits another one. A message whose text is a JSON object with tool_calls gives a row for each
    call; one with tool_call_id gives a result, one with both gives both. A calling message's content that is no result
    is a plain row before its calls. A call's name and arguments may stand in its function; arguments are an object or a
    string that holds one, keep their JSON types, and keys are sorted at all depths; no arguments are none. Members
    that have no place of their own are kept as extra, a call's in its row, a message's in its result or plain row. A text that
    can't be read so stays a plain row as it is: no JSON, a repeated key at any depth (JSON text of such objects inside
    strings stays a string), tool_calls that aren't a list of objects.

    The parts of messages are written to the shared folder, so each text is parsed once. Calls and results meet in a
    hash join on (conv_id, call id), so neither a hot conversation nor a hot first turn is gathered anywhere. The order
    (anchor_turn, step, turn, pos) is topological and, where turns are unique, total: a result is anchored at its call's
    turn when it stands before it, steps put calls before their results, and pos is a call's place in its message.

    status: ``plain``; for calls ``ok``, ``unknown_tool``, ``missing_argument``, ``unknown_argument``, ``bad_type`` or
    ``no_result`` (the arguments are right but no result came), and ``duplicate`` for all but the first call of an id;
    for results ``linked`` or ``orphan``. Arguments that are no object are ``bad_type`` and written as they are. Null
    or blank ids never link, nor do rows without a conv_id. Of calls that share an id the first by turn and place
    counts; repeated rows each stay. A null text is an empty message, a null role the role ``unknown``. An empty table
    gives an empty result, other columns play no part. JSON has no white space.
    """
    p = stage(parts(messages), "parts")
    plain = p.filter("kind = 0").select("conv_id", "turn", "role", "call_id", F.col("turn").alias("anchor_turn"), F.lit(0).alias("step"), "pos", F.lit("plain").alias("status"), "message")
    tools = p.filter("kind > 0")
    able = F.col("call_id").isNotNull() & F.col("conv_id").isNotNull()
    first = F.min(F.when(F.col("kind") == 1, F.struct("turn", "pos")))
    links = tools.filter(able).groupBy("conv_id", "call_id").agg(first.alias("first"), F.count_if(F.col("kind") == 2).alias("n_results"))
    alone = tools.filter(~able).withColumns({"first": F.lit(None).cast("struct<turn:bigint,pos:int>"), "n_results": F.lit(0).cast("long")})
    met = tools.filter(able).join(links, ["conv_id", "call_id"]).withColumn("first", F.col("first").cast("struct<turn:bigint,pos:int>")).unionByName(alone)
    kinds = schemas.groupBy("name").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("param", "type")))).alias("wanted"), F.collect_set(F.when(F.col("required"), F.col("param"))).alias("needed"))
    met = met.join(kinds, "name", "left")
    fits = lambda e: F.coalesce((e["value"] == F.element_at("wanted", e["key"])) | (e["value"] == "integer") & (F.element_at("wanted", e["key"]) == "number"), F.lit(False))
    called = (
        F.when((F.col("first.turn") != F.col("turn")) | (F.col("first.pos") != F.col("pos")), "duplicate")
        .when(F.col("wanted").isNull(), "unknown_tool")
        .when(~F.col("is_object"), "bad_type")
        .when(F.size(F.array_except("needed", F.map_keys("types"))) > 0, "missing_argument")
        .when(F.size(F.array_except(F.map_keys("types"), F.map_keys("wanted"))) > 0, "unknown_argument")
        .when(F.exists(F.map_entries("types"), lambda e: ~fits(e)), "bad_type")
        .when(F.col("n_results") == 0, "no_result")
        .otherwise("ok")
    )
    status = F.when(F.col("kind") == 1, called).when(F.col("first").isNull(), "orphan").otherwise("linked")
    anchor = F.when(F.col("kind") == 1, F.col("turn")).otherwise(F.greatest("turn", "first.turn"))
    return plain.unionByName(met.select("conv_id", "turn", "role", "call_id", anchor.alias("anchor_turn"), F.col("kind").alias("step"), "pos", status.alias("status"), "message"))
