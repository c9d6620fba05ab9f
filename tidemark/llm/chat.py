"""Chat formatting with tool calls linked to their results.

Calls and results are hash-joined by conversation and call id, calls are put in
topological order of their dependencies, arguments are checked against the tools'
schemas, and every record becomes one line of canonical JSON (keys sorted, no spaces,
numbers as plain decimals, so that 1, 1.0 and 1e0 are one text). A number that no double
can hold makes the arguments invalid, and they stay as the text that they were.
The order takes rounds in the logarithm of the longest chain of calls.

A record's place is (conv_id, place, level, pos, part): a call stands at its own turn or
that of the latest call it depends on, at a level above it, and its result follows it.
The order is in columns, so no conversation is gathered in one task; all keys of joins
and aggregates hold the call id, so one conversation may hold any share of the rows.

DataFrame functions only. Null or non-JSON text is an ordinary message, and so is any row
without a conv_id; a null role is 'unknown'. Of calls or results that repeat an id the
first turn counts; each other one is a row too ('repeated id', 'repeated result'), as is a
call with a null id ('no id'): such a call stands after all that it depends on, such a
result after its call. Results without a call, calls without a result and cycles are marked
and kept. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Staging, let, staged

CALLS = "struct<content:string,tool_calls:array<struct<id:string,name:string,arguments:string,depends_on:array<string>>>>"
RESULT = "struct<tool_call_id:string,content:string>"

#: Levels end here, so that what goes round in a cycle does not overflow.
MOST = 1 << 29

#: tool -> parameter -> (type, required).
TOOLS: dict[str, dict[str, tuple[str, bool]]] = {
    "reply": {"max_words": ("integer", True), "style": ("string", True), "strict": ("boolean", False)},
}
#: JSON type -> type that a parsed variant reports.
TYPES = {"string": "^STRING", "boolean": "^BOOLEAN", "object": "^OBJECT", "array": "^ARRAY"}

#: Numbers travel through the variant as texts behind this mark, a private character, so that none loses a digit.
MARK, FAR = "\ue000#", "\ue000?"
_NUMBER = r"(?<![^\s,:\[\]{}])-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?(?![^\s,:\[\]{}])"


def messages(conversations: DataFrame, text: str = "text") -> DataFrame:
    """conv_id, turn, role, content, calls, call_id of every turn."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit("unknown"))
    known = F.col("conv_id").isNotNull()  # records are linked within a conversation only
    calls = F.when(known & (role == "assistant") & F.startswith(F.ltrim(t), F.lit("{")) & F.contains(t, F.lit('"tool_calls"')), F.from_json(t, CALLS))
    result = F.when(known & (role == "tool") & F.startswith(F.ltrim(t), F.lit("{")), F.from_json(t, RESULT))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), t.alias("t"), calls.alias("c"), result.alias("r"))
    content = F.when(F.col("r.tool_call_id").isNotNull(), F.coalesce("r.content", F.lit(""))).when(F.col("c.tool_calls").isNotNull(), F.coalesce("c.content", F.lit(""))).otherwise(F.col("t"))
    return rows.select("conv_id", "turn", "role", content.alias("content"), F.col("c.tool_calls").alias("calls"), F.col("r.tool_call_id").alias("call_id"))


def canonical_number(t: Column) -> Column:
    """The one plain decimal form of a JSON number, so that equal values are equal texts; null beyond what a double can hold."""
    part = lambda pattern: F.regexp_extract(t, pattern, 1)
    whole, fraction, power = part("^-?([0-9]+)"), part(r"\.([0-9]+)"), part("[eE]([+-]?[0-9]+)$")
    exponent = F.when(power == "", F.lit(0)).otherwise(F.when(F.char_length(F.regexp_replace(power, "^[+-]?0*", "")) <= 6, power.try_cast("int")))

    def plain(x: Column) -> Column:
        digits = F.regexp_replace(x["all"], "^0+", "")
        point = x["n"] + x["e"] - (F.char_length(x["all"]) - F.char_length(digits))
        short = F.regexp_replace(digits, "0+$", "")
        size = F.char_length(short)
        text = F.when(point >= size, F.concat(short, F.repeat(F.lit("0"), point - size))).when(point > 0, F.concat(F.substring(short, F.lit(1), point), F.lit("."), F.substring(short, point + 1, size))).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), short))
        held = point.between(-340, 309) & (F.abs(t.try_cast("double")) < F.lit(float("inf")))
        return F.when(short == "", F.lit("0")).when(held, F.concat(F.when(t.startswith("-"), "-").otherwise(""), text))

    return let(F.struct(F.concat(whole, fraction).alias("all"), F.char_length(whole).alias("n"), exponent.alias("e")), plain)


def marked_numbers(arguments: Column) -> Column:
    """JSON text in which each number outside strings is a text: its canonical form behind MARK, or FAR where there is none.

    Every second piece between quotes lies outside strings. Texts that hold the private character stay as they are.
    """
    def marked(piece: Column) -> Column:
        parts = F.struct(F.split(piece, _NUMBER).alias("gaps"), F.regexp_extract_all(piece, F.lit(_NUMBER), F.lit(0)).alias("hits"))
        one = lambda t: F.concat(F.lit('"'), F.coalesce(F.concat(F.lit(MARK), canonical_number(t)), F.lit(FAR)), F.lit('"'))
        return let(parts, lambda p: F.array_join(F.transform(p["gaps"], lambda g, i: F.concat(g, F.when(i < F.size(p["hits"]), one(F.get(p["hits"], i))).otherwise(F.lit("")))), ""))

    safe = F.replace(F.replace(arguments, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))
    joined = F.array_join(F.transform(F.split(safe, '"'), lambda x, i: F.when(i % 2 == 0, marked(x)).otherwise(x)), '"')
    whole = F.replace(F.replace(joined, F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\"))
    return F.when(F.rlike(arguments, F.lit("(?i)\ue000|\\\\ue000|[\x01\x02]")), arguments).otherwise(whole)


def argument_errors(name: Column, arguments: Column, tools: dict = TOOLS) -> Column:
    """Errors of a call's arguments, in order of the schema; unknown parameters last. An integer is one by value: 1.0 and 1e2 are."""
    made = marked_numbers(arguments)
    parsed = F.try_parse_json(made)
    out = F.array(F.concat(F.lit("unknown tool "), F.coalesce(name, F.lit("")))).cast("array<string>")
    keys = F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>"))
    for tool, params in tools.items():
        checks = []
        for p, (kind, required) in params.items():
            value = F.try_variant_get(parsed, f"$.{p}", "variant")
            numeric = F.startswith(F.coalesce(F.try_variant_get(parsed, f"$.{p}", "string"), F.lit("")), F.lit(MARK))
            if kind in ("integer", "number"):
                fits = numeric if kind == "number" else numeric & ~F.contains(F.try_variant_get(parsed, f"$.{p}", "string"), F.lit("."))
            else:
                fits = F.rlike(F.schema_of_variant(value), F.lit(TYPES[kind])) & (~numeric if kind == "string" else F.lit(True))
            present = F.array_contains(keys, p)
            checks.append(F.when(~present, F.lit(f"missing {p}") if required else F.lit(None)).when(~F.coalesce(fits, F.lit(False)), F.lit(f"{p} is not {kind}")))
        extra = F.transform(F.array_except(keys, F.array(*map(F.lit, params))), lambda k: F.concat(F.lit("unknown "), k))
        errors = F.concat(F.array_compact(F.array(*checks)), extra)
        out = F.when(name == tool, F.when(parsed.isNull(), F.array(F.lit("malformed arguments"))).when(F.contains(made, F.lit(FAR)), F.array(F.lit("number out of range"))).otherwise(errors)).otherwise(out)
    return out


def ordered_calls(calls: DataFrame, tables: Staging) -> DataFrame:
    """Calls with ``place`` and ``level``: at or after all that they depend on; null level in a cycle.

    An open dependency (dep, add, level, place) says that a call stands at least at
    ``level`` and ``place``, at least ``add`` levels above ``dep`` and not before it. In each
    round it is settled if ``dep`` is known, and passed on to what ``dep`` itself waits for if
    that is a single call, so that a chain of n calls takes about log2(n) rounds; calls with
    several open dependencies wait for them. What no round settles any more is a cycle or
    hangs on one. Rounds join staged tables on (conv_id, call id).
    """
    key = ["conv_id", "id"]
    waiting = calls.filter(F.size("depends_on") > 0).select(*key, "turn", F.explode(F.array_compact(F.array_distinct("depends_on"))).alias("dep"))
    # dependencies that name no call hold nothing up
    there = calls.select("conv_id", F.col("id").alias("dep")).distinct()
    edges = tables.put(waiting.join(there, ["conv_id", "dep"], "left_semi").select(*key, "dep", F.lit(1).cast("long").alias("add"), F.lit(0).cast("long").alias("level"), F.col("turn").alias("place")), "chat-open")
    known = tables.put(calls.join(edges.select(*key).distinct(), key, "left_anti").select(*key, F.lit(0).cast("long").alias("level"), F.col("turn").alias("place")), "chat-known")
    left = edges.count()
    while left:
        single = edges.groupBy(*key).agg(F.count("*").alias("n"), F.max("dep").alias("to"), F.max("add").alias("by"), F.max("level").alias("floor"), F.max("place").alias("after")).filter("n = 1")
        state = known.select("conv_id", F.col("id").alias("dep"), F.lit(None).cast("string").alias("to"), F.lit(0).cast("long").alias("by"), F.col("level").alias("floor"), F.col("place").alias("after"))
        state = state.unionByName(single.select("conv_id", F.col("id").alias("dep"), "to", "by", "floor", "after"))
        met = edges.join(state.withColumn("met", F.lit(True)), ["conv_id", "dep"], "left")
        step = met.select(
            *key, F.when(F.col("met"), F.col("to")).otherwise(F.col("dep")).alias("dep"), F.least(F.col("add") + F.coalesce("by", F.lit(0)), F.lit(MOST)).alias("add"),
            F.greatest("level", F.when(F.col("met"), F.least(F.col("floor") + F.col("add"), F.lit(MOST)))).alias("level"), F.greatest("place", "after").alias("place"),
        )
        step = tables.put(step, "chat-step")
        settled = step.groupBy(*key).agg(F.count("dep").alias("n"), F.max("level").alias("level"), F.max("place").alias("place")).filter("n = 0").drop("n")
        # what is settled of a call that waits on stays as the least that its other dependencies allow
        bounds = step.groupBy(*key).agg(F.max("level").alias("floor"), F.max("place").alias("after"))
        open_ = tables.put(step.filter("dep is not null").groupBy(*key, "dep").agg(F.max("add").alias("add")).join(bounds, key).select(*key, "dep", "add", F.col("floor").alias("level"), F.col("after").alias("place")), "chat-open")
        now = tables.put(known.unionByName(settled), "chat-known")
        tables.drop(edges, known, step)
        edges, known = open_, now
        waits = edges.select(*key).distinct().count()
        if waits == left:
            break
        left = waits
    cycles = edges.select(*key).distinct().join(calls.select(*key, "turn"), key).select(*key, F.lit(None).cast("long").alias("level"), F.col("turn").alias("place"))
    return calls.join(known.unionByName(cycles).withColumn("level", F.col("level").cast("int")), key)


CALL, ANSWER = ("no_turn", "turn", "pos", "name", "arguments", "depends_on"), ("no_turn", "turn", "content")


def _others(each: DataFrame, heads: DataFrame, fields: tuple[str, ...], keep: tuple[str, ...] = ()) -> DataFrame:
    """conv_id, id, ``fields``, ``keep`` and m: rows of ``each`` that are not their id's ``first`` in ``heads``; m equal rows are one."""
    there = heads.select(F.col("conv_id").alias("there_conv"), F.col("id").alias("there_id"), "first", *keep)
    met = each.join(there, (F.col("conv_id") == F.col("there_conv")) & F.col("id").eqNullSafe(F.col("there_id")))
    first = F.col("id").isNotNull() & F.struct(*fields).eqNullSafe(F.col("first"))
    alike = met.groupBy("conv_id", "id", *fields, *keep, first.alias("is_first")).agg(F.count("*").alias("m"))
    return alike.withColumn("m", (F.col("m") - F.col("is_first").cast("int")).cast("int")).filter("m > 0").drop("is_first")


def _copies(rows: DataFrame) -> DataFrame:
    return rows.withColumn("m", F.explode(F.array_repeat(F.lit(1), F.col("m"))))


def _placed(others: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls that no other call can name, with ``place`` and ``level`` after the calls that they depend on."""
    key = ["conv_id", "id", *CALL, "m"]
    there = calls.select("conv_id", F.col("id").alias("dep"), F.col("place").alias("after"), F.coalesce("level", F.lit(1 << 30)).alias("above"))
    met = others.withColumn("dep", F.explode_outer(F.array_distinct("depends_on"))).join(there, ["conv_id", "dep"], "left")
    at = met.groupBy(*key).agg(F.max("after").alias("after"), F.max("above").alias("above"))
    level = F.when(F.col("above") == 1 << 30, F.lit(None)).otherwise(F.coalesce(F.col("above") + 1, F.lit(0))).cast("int")
    return at.select(*key, F.greatest("turn", "after").alias("place"), level.alias("level"))


def _call_rows(calls: DataFrame) -> DataFrame:
    """Output rows of calls with place, level, status and errors."""
    made = marked_numbers(F.col("arguments"))
    canonical = F.coalesce(F.try_parse_json(F.when(~F.contains(made, F.lit(FAR)), made)), F.parse_json(F.to_json(F.struct(F.col("arguments").alias("malformed")))))
    line = F.to_json(F.struct(canonical.alias("arguments"), "id", "name", F.lit("assistant").alias("role"), F.lit("call").alias("type")))
    return calls.select("conv_id", "place", F.coalesce("level", F.lit(1 << 30)).alias("level"), "pos", F.lit(1).alias("part"), F.lit("call").alias("kind"), "status", "errors", F.regexp_replace(line, f'"{MARK}([^"]*)"', "$1").alias("line"))


def _result_rows(results: DataFrame) -> DataFrame:
    """Output rows of results with content, place, level, pos, part and status."""
    line = F.to_json(F.struct("content", "id", F.lit("tool").alias("role"), F.lit("result").alias("type")))
    return results.select("conv_id", "place", "level", "pos", "part", F.lit("result").alias("kind"), "status", F.array().cast("array<string>").alias("errors"), line.alias("line"))


def linked(conversations: DataFrame, tools: dict = TOOLS, text: str = "text") -> DataFrame:
    """conv_id, place, level, pos, part, kind, status, errors, line: every record of every conversation."""
    turns = messages(conversations, text)
    plain = turns.filter("call_id is null").select("conv_id", F.col("turn").alias("place"), F.lit(-1).alias("level"), F.lit(0).alias("pos"), F.lit(0).alias("part"), F.lit("message").alias("kind"), F.lit("ok").alias("status"), F.array().cast("array<string>").alias("errors"), F.to_json(F.struct("content", "role", F.lit("message").alias("type"))).alias("line"))
    no_turn = F.col("turn").isNull().alias("no_turn")  # sorts after the turns that are known
    each = turns.filter("calls is not null").select("conv_id", "turn", no_turn, F.posexplode("calls").alias("pos", "c")).select("conv_id", "turn", "no_turn", "pos", "c.id", "c.name", "c.arguments", F.coalesce("c.depends_on", F.array().cast("array<string>")).alias("depends_on"))
    heads = staged(each.groupBy("conv_id", "id").agg(F.min(F.struct(*CALL)).alias("first"), F.count("*").alias("n")), "chat-calls")
    answers = turns.filter("call_id is not null").select("conv_id", F.col("call_id").alias("id"), "turn", no_turn, "content")
    results = answers.groupBy("conv_id", "id").agg(F.min(F.struct(*ANSWER)).alias("r"), F.count("*").alias("n_results"))
    with Staging(conversations.sparkSession) as tables:
        calls = ordered_calls(heads.filter("id is not null").select("conv_id", "id", "first.*", "n"), tables)
        both = staged(calls.join(results.hint("shuffle_hash"), ["conv_id", "id"], "full_outer"), "chat-linked")
    errors = argument_errors(F.col("name"), F.col("arguments"), tools)
    status = F.when(F.col("level").isNull(), "cycle").when(F.size("errors") > 0, "invalid").when(F.col("r").isNull(), "no result").otherwise("linked")
    call_rows = _call_rows(both.filter("n is not null").withColumn("errors", errors).withColumn("status", status))
    level = F.coalesce("level", F.when(F.col("n").isNull(), F.lit(-1)).otherwise(F.lit(1 << 30)))
    first_results = both.filter("r is not null").select("conv_id", "id", "r.content", F.coalesce("place", "r.turn").alias("place"), level.alias("level"), F.coalesce("pos", F.lit(0)).alias("pos"), F.lit(2).alias("part"), F.when(F.col("n").isNull(), "no call").otherwise("linked").alias("status"))
    rows = [plain, call_rows, _result_rows(first_results)]
    # only where ids repeat or are null are the records read again
    more = heads.filter("id is null or n > 1")
    if not more.isEmpty():
        others = _placed(_others(each, more, CALL), both.filter("n is not null"))
        rows.append(_call_rows(_copies(others).withColumn("errors", errors).withColumn("status", F.when(F.col("id").isNull(), "no id").otherwise("repeated id"))))
    more = both.filter("n_results > 1").select("conv_id", "id", F.col("r").alias("first"), "place", level.alias("level"), F.col("pos").alias("call_pos"))
    if not more.isEmpty():
        others = _others(answers, more, ANSWER, ("place", "level", "call_pos"))
        late = F.col("turn") > F.col("place")  # after its call's place: stands at its own turn
        own = F.col("call_pos").isNull() | F.coalesce(late, F.lit(False))
        at = [F.when(own, F.col("turn")).otherwise(F.col("place")).alias("place"), F.when(own, -1).otherwise(F.col("level")).alias("level"), F.when(own, 0).otherwise(F.col("call_pos")).alias("pos"), F.when(own, 2).otherwise(3).alias("part")]
        rows.append(_result_rows(_copies(others).select("conv_id", "id", "content", *at, F.lit("repeated result").alias("status"))))
    return reduce(DataFrame.unionByName, rows)


def as_tool_calls(conversations: DataFrame) -> DataFrame:
    """Plain conversations in tool-call form: each user turn calls ``reply``, the next assistant turn is its result.

    Every second call depends on the one before it; turns that want more than 30 words of
    request are sent with an argument of the wrong type, so that validation has work. Rows
    without a conv_id or a turn can't be named by an id and stay as they are.
    """
    keyed = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    n = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"\s+"), "")).cast("int")
    ident = lambda turn: F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), turn)
    words = F.when(n > 30, F.concat(F.lit('"'), n, F.lit('"'))).otherwise(n.cast("string"))
    arguments = F.concat(F.lit('{"style": "plain", "max_words": '), words, F.lit("}"))
    deps = F.when(F.col("turn") % 4 >= 2, F.concat(F.lit('["'), ident(F.col("turn") - 2), F.lit('"]'))).otherwise(F.lit("[]"))
    call = F.concat(F.lit('{"content": '), F.to_json(F.struct("text")), F.lit(', "tool_calls": [{"id": "'), ident(F.col("turn")), F.lit('", "name": "reply", "arguments": '), arguments, F.lit(', "depends_on": '), deps, F.lit("}]}"))
    result = F.to_json(F.struct(ident(F.col("turn") - 1).alias("tool_call_id"), F.coalesce("text", F.lit("")).alias("content")))
    body = F.when(keyed & (F.col("role") == "user"), call).when(keyed & (F.col("role") == "assistant"), result).otherwise(F.col("text"))
    role = F.when(keyed & (F.col("role") == "user"), "assistant").when(keyed & (F.col("role") == "assistant"), "tool").otherwise(F.col("role"))
    return conversations.select("conv_id", "turn", role.alias("role"), body.alias("text"))
