"""Chat formatting with tool-call linking, with DataFrame functions only.

Messages have a conversation, a turn, a role and a text.  An assistant's text may hold calls, each a JSON object between
``<tool_call>`` and ``</tool_call>`` with id, name, arguments and depends_on (ids of calls whose results it uses); a message of role ``tool`` is
the result of the call that its JSON object names in tool_call_id, with a content.  Everything else is a plain message.

Linking.  Calls and results are hash-joined by conversation and id.  The first call and the first result of an id (by turn, then place) count, later ones are
``duplicate``; without its counterpart a call is ``unanswered`` and a result an ``orphan``; what names no id or isn't JSON is ``malformed``.

Order.  Each event gets ``after_turn`` and ``level`` so that sorting a conversation by (after_turn, level, turn, place) puts a result behind its
call and a call behind the results it depends on, however late the log has them: after_turn is the latest turn among an event and all it depends on, level counts the
steps within that turn.  A conversation in which no call comes before a result it needs is settled by one join.  The calls of the others are packed, in order of turns, into chunks of
about 256; inside a chunk's row the calls whose needs are known are placed, walking up and down, and what other chunks need goes to them by a join, until nothing is added: a round for each
time that a dependency crosses chunks or turns against the walk, not for each step.  Calls that stay open (on a cycle or waiting for one) are ``cyclic`` and keep their own turn.

Arguments are checked against ``schemas`` (tool: field: type and whether it is required); errors are listed by field.  JSON is canonical: keys in order, no
white space, absent where null.

Nulls and ties.  A null conversation or id links with nothing; a null turn comes last; a null text is an empty message; equal rows stay as they are, the
second call with an id is a duplicate.  An empty table gives no rows.  Extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairoscope.session import cut

#: Types: string, integer, number, boolean, object, array.
SCHEMAS = {"reply": {"prompt": ("string", True), "turn": ("integer", True)}}
_KINDS = {"string": "^STRING", "integer": "^BIGINT", "number": "^(BIGINT|DOUBLE|DECIMAL|FLOAT)", "boolean": "^BOOLEAN", "object": "^(OBJECT|STRUCT)", "array": "^ARRAY"}
LAST = (1 << 63) - 1
#: Calls in a chunk, the most that one row holds (about; a long conversation has many chunks).
CHUNK = 256


def exchanges(conversations: DataFrame) -> DataFrame:
    """Messages in which each user turn is a call of ``reply`` and the assistant turn behind it its result; each call depends on the one two turns before.

    By the remainder of conv_id by 6 the log has a fault: 1, the first call comes 100 turns late, so all that wait for it do; 2, results are repeated 50 turns later;
    3, the first call waits for the second; 4, arguments break the schema; 5, results aren't JSON; 0, none.
    """
    mode = F.pmod(F.col("conv_id"), F.lit(6))
    turn, first = F.col("turn"), F.col("turn") < 2
    name = lambda turn: F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), turn.cast("string"))
    depends = F.when(turn >= 2, F.array(name(turn - 2))).when((mode == 3) & first, F.array(name(turn + 2)))
    plain = F.struct(F.col("text").alias("prompt"), turn.alias("turn"))
    broken = F.struct(F.lit("x").alias("note"), turn.alias("prompt"), turn.cast("string").alias("turn"))
    call = lambda arguments: F.to_json(F.struct(arguments.alias("arguments"), depends.alias("depends_on"), name(turn).alias("id"), F.lit("reply").alias("name")))
    marked = F.concat(F.lit("<tool_call>"), F.replace(F.when(mode == 4, call(broken)).otherwise(call(plain)), F.lit("<"), F.lit("\\u003c")), F.lit("</tool_call>"))
    result = F.when(mode == 5, F.concat(F.lit("not JSON: "), F.coalesce("text", F.lit("")))).otherwise(F.to_json(F.struct(F.col("text").alias("content"), name(turn - 1).alias("tool_call_id"))))
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    text = F.when(user, marked).when(assistant, result).otherwise(F.col("text"))
    role = F.when(user, "assistant").when(assistant, "tool").otherwise(F.col("role"))
    late = F.when(user & (mode == 1) & first, turn + 100).otherwise(turn)
    turns = F.when(assistant & (mode == 2), F.array(late, late + 50)).otherwise(F.array(late))
    return conversations.select("conv_id", F.explode(turns).alias("turn"), role.alias("role"), text.alias("text"))


def argument_errors(name: Column, arguments: Column, keys: Column, schemas: dict) -> Column:
    """What is wrong with a call's arguments, as an array of ``field: reason`` in order of the fields."""
    errors = F.array(F.lit("unknown tool"))
    for tool, fields in sorted(schemas.items()):
        found = []
        for field, (kind, required) in sorted(fields.items()):
            value = F.try_variant_get(arguments, f"$.{field}", "variant")
            if required:
                found.append(F.when(value.isNull(), f"{field}: missing"))
            found.append(F.when(value.isNotNull() & ~F.schema_of_variant(value).rlike(_KINDS[kind]), f"{field}: not of type {kind}"))
        extra = F.transform(F.array_sort(F.array_except(F.coalesce(keys, F.array().cast("array<string>")), F.array(*map(F.lit, sorted(fields))))), lambda k: F.concat(k, F.lit(": unexpected")))
        errors = F.when(name == tool, F.concat(F.array_compact(F.array(*found)) if found else F.array().cast("array<string>"), extra)).otherwise(errors)
    return errors


def parsed(messages: DataFrame) -> DataFrame:
    """One row per event: conv_id, turn, place, kind (call, result or message), call_id, name, arguments, keys, depends, body."""
    base = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    calls = F.regexp_extract_all("text", F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), F.lit(1))
    empty = F.array(F.lit(None).cast("string"))
    pieces = base.withColumn("calls", F.when(F.col("role") == "assistant", calls)).select("*", F.posexplode(F.when(F.size("calls") > 0, F.col("calls")).otherwise(empty)).alias("place", "raw")).drop("calls")
    is_call, is_result = F.col("raw").isNotNull(), F.col("role").eqNullSafe("tool")
    pieces = pieces.withColumn("kind", F.when(is_call, "call").when(is_result, "result").otherwise("message"))
    pieces = pieces.withColumn("json", F.try_parse_json(F.when(is_call, F.col("raw")).when(is_result, F.col("text"))))
    field = lambda path, kind="string": F.try_variant_get("json", path, kind)
    return pieces.select(
        "conv_id",
        "turn",
        "place",
        "role",
        "kind",
        F.when(is_call, field("$.id")).when(is_result, field("$.tool_call_id")).alias("call_id"),
        F.when(is_call, field("$.name")).alias("name"),
        F.when(is_call, F.coalesce(field("$.arguments", "variant"), F.parse_json(F.lit("{}")))).alias("arguments"),
        F.when(is_call, F.json_object_keys(F.to_json(field("$.arguments", "variant")))).alias("keys"),
        F.when(is_call, field("$.depends_on", "array<string>")).alias("depends"),
        F.when(is_result & F.col("json").isNotNull(), field("$.content")).when(~is_call, F.col("text")).alias("body"),
    )


def linked(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events with status, links): links has conv_id, call_id, depends and the turns of the first call and its first result."""
    named = events.where("conv_id IS NOT NULL AND call_id IS NOT NULL")
    when = F.struct(F.coalesce("turn", F.lit(LAST)).alias("turn"), "place")
    first = named.groupBy("conv_id", "call_id").agg(
        F.min(F.when(F.col("kind") == "call", when)).alias("call"),
        F.min(F.when(F.col("kind") == "result", when)).alias("result"),
        F.min_by(F.when(F.col("kind") == "call", F.col("depends")), F.when(F.col("kind") == "call", when)).alias("depends"),
    )
    joined = events.join(first.select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"), "call", "result"), (F.col("conv_id") == F.col("c")) & (F.col("call_id") == F.col("i")), "left")
    own = F.when(F.col("kind") == "call", F.col("call")).otherwise(F.col("result"))
    status = (
        F.when(F.col("kind") == "message", "message")
        .when(F.col("conv_id").isNull() | F.col("call_id").isNull(), "malformed")
        .when((own["turn"] != F.coalesce("turn", F.lit(LAST))) | (own["place"] != F.col("place")), "duplicate")
        .when(F.col("call").isNull(), "orphan")
        .when(F.col("result").isNull(), "unanswered")
        .otherwise("linked")
    )
    return joined.withColumn("status", status).drop("c", "i", "call", "result"), first.where("call IS NOT NULL").select("conv_id", "call_id", "depends", F.col("call.turn").alias("turn"), F.col("result.turn").alias("result_turn"))


def _place(turn: Column, level: Column) -> Column:
    return F.struct(turn.alias("turn"), level.cast("int").alias("level"))


def _answer(at: Column, result_turn: Column) -> Column:
    """The place of a result: behind its call, in its own turn where that is later, else a level below the call."""
    return F.when(result_turn > at["turn"], _place(result_turn, F.lit(0))).otherwise(_place(at["turn"], at["level"] + 1))


def _behind(turn: Column, needs: Column, answers: Column) -> Column:
    """The place of a call whose ``needs`` are all in ``answers``."""
    own, last = _place(turn, F.lit(0)), F.array_max(F.transform(needs, lambda n: F.try_element_at(answers, n)))
    return F.when(last >= own, _place(last["turn"], last["level"] + 1)).otherwise(own)


def _ready(needs: Column, answers: Column) -> Column:
    return F.forall(needs, lambda n: F.map_contains_key(answers, n))


def _settled(calls: Column, answers: Column) -> Column:
    """``answers`` with those of all calls that follow from it by walks up and down ``calls``."""

    def step(known: Column, call: Column) -> Column:
        answer = _answer(_behind(call["turn"], call["needs"], known), call["result_turn"])
        news = F.create_map(call["call_id"], answer)
        return F.when(~F.map_contains_key(known, call["call_id"]) & _ready(call["needs"], known), F.map_concat(known, news)).otherwise(known)

    return F.aggregate(F.concat(calls, F.reverse(calls), calls), answers, step)


def _chunked(links: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks of about CHUNK calls: conv_id, chunk, calls, answers; needs across chunks: conv_id, chunk, home, needs), for conversations with calls that come too early."""
    early = edges.where(F.col("given") >= F.col("at")).select("conv_id").distinct()
    dated = F.when(F.col("turn") < LAST, F.col("turn").cast("double"))
    sizes = links.groupBy("conv_id").agg(F.count("*").alias("n"), F.min(dated).alias("lo"), F.max(dated).alias("hi")).join(early, "conv_id", "left_semi")
    stretch = F.when(F.col("n") <= CHUNK, 0).when(F.col("turn") == LAST, -1).otherwise(F.floor((F.col("turn") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1) * F.col("n") / CHUNK))
    calls = links.join(sizes, "conv_id").select("conv_id", "call_id", "turn", "result_turn", (F.col("n") > CHUNK).alias("large"), stretch.cast("long").alias("stretch"))
    # A stretch with more calls than others is split once more, by id.
    split = calls.groupBy("conv_id", "stretch").agg(F.ceil(F.count("*") / CHUNK).alias("split"))
    calls = cut(calls.join(split, ["conv_id", "stretch"]).withColumn("chunk", F.struct("stretch", F.pmod(F.xxhash64("call_id"), F.col("split")).alias("part"))).drop("stretch", "split"))
    needs = edges.groupBy("conv_id", "call_id").agg(F.collect_list("needs").alias("needs"))
    call = F.struct("turn", "call_id", "result_turn", F.coalesce("needs", F.array().cast("array<string>")).alias("needs"))
    chunks = calls.join(needs, ["conv_id", "call_id"], "left").groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_list(call)).alias("calls"))
    homes = calls.where("large").select("conv_id", "call_id", "chunk")
    across = edges.select("conv_id", "call_id", "needs").join(homes, ["conv_id", "call_id"])
    across = across.join(homes.select("conv_id", F.col("call_id").alias("needs"), F.col("chunk").alias("home")), ["conv_id", "needs"]).where("chunk <> home")
    nothing = F.map_from_entries(F.array().cast("array<struct<id:string,at:struct<turn:bigint,level:int>>>"))
    return chunks.withColumn("answers", nothing), across.select("conv_id", "chunk", "home", "needs").distinct()


def topological(links: DataFrame) -> DataFrame:
    """links with ``at`` and ``answer``: (turn, level) of the call and of its result; and ``cyclic``."""
    base = links.withColumn("at", _place(F.col("turn"), F.lit(0)))
    base = cut(base.withColumn("answer", _answer(F.col("at"), F.col("result_turn"))))
    known = base.select("conv_id", F.col("call_id").alias("needs"), F.col("answer").alias("given"))
    edges = cut(base.select("conv_id", "call_id", "at", F.explode(F.array_distinct("depends")).alias("needs")).join(known, ["conv_id", "needs"]))
    chunks, across = _chunked(base, edges)
    across, before = cut(across), -1
    is_across = not across.isEmpty()
    while True:
        chunks = cut(chunks.withColumn("answers", _settled(F.col("calls"), F.col("answers"))))
        open_ = F.exists("calls", lambda c: ~F.map_contains_key("answers", c["call_id"]))
        now, left = chunks.agg(F.coalesce(F.sum(F.size("answers")), F.lit(0)), F.count(F.when(open_, True))).first()
        if not left or now == before:
            break
        before = now
        if is_across:
            given = chunks.select("conv_id", F.col("chunk").alias("home"), F.explode("answers").alias("needs", "given")).join(across, ["conv_id", "home", "needs"])
            given = given.groupBy("conv_id", "chunk").agg(F.map_from_entries(F.collect_list(F.struct("needs", "given"))).alias("given"))
            news = F.map_filter("given", lambda k, _: ~F.map_contains_key("answers", k))
            chunks = chunks.join(given, ["conv_id", "chunk"], "left").withColumn("answers", F.when(F.col("given").isNull(), F.col("answers")).otherwise(F.map_concat("answers", news))).drop("given")
    call, ready = F.col("call"), _ready(F.col("call.needs"), F.col("answers"))
    own = chunks.select("conv_id", "answers", F.explode("calls").alias("call"))
    own = own.select("conv_id", "call.call_id", F.when(ready, _behind(call["turn"], call["needs"], F.col("answers"))).alias("moved"), (~ready).alias("stuck"))
    placed = base.join(own, ["conv_id", "call_id"], "left").withColumn("at", F.coalesce("moved", "at")).withColumn("cyclic", F.coalesce("stuck", F.lit(False)))
    return placed.withColumn("answer", _answer(F.col("at"), F.col("result_turn"))).drop("moved", "stuck")


def format_chat(messages: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """One row per event: conv_id, turn, place, kind, call_id, status, after_turn, level, errors, json."""
    events, links = linked(parsed(messages))
    order = topological(links).select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"), "at", "answer", "cyclic")
    placed = events.join(order, (F.col("conv_id") == F.col("c")) & (F.col("call_id") == F.col("i")) & F.col("status").isin("linked", "unanswered"), "left")
    spot = F.when(F.col("kind") == "call", F.col("at")).when(F.col("kind") == "result", F.col("answer"))
    call = F.to_json(F.struct("arguments", F.col("call_id").alias("id"), "name", F.col("kind").alias("type")))
    result = F.to_json(F.struct(F.col("body").alias("content"), F.col("call_id").alias("id"), F.col("kind").alias("type")))
    message = F.to_json(F.struct(F.col("body").alias("content"), "role", F.col("kind").alias("type")))
    return placed.select(
        "conv_id",
        "turn",
        F.col("place").cast("long").alias("place"),
        "kind",
        "call_id",
        F.when(F.col("cyclic"), "cyclic").otherwise(F.col("status")).alias("status"),
        F.coalesce(spot["turn"], F.col("turn"), F.lit(LAST)).alias("after_turn"),
        F.coalesce(spot["level"], F.lit(0)).cast("long").alias("level"),
        F.array_join(F.when(F.col("kind") == "call", argument_errors(F.col("name"), F.col("arguments"), F.col("keys"), schemas)).otherwise(F.array().cast("array<string>")), "; ").alias("errors"),
        F.when(F.col("kind") == "call", call).when(F.col("kind") == "result", result).otherwise(message).alias("json"),
    )


def op7_chat_format(spark, sf_dir: str) -> DataFrame:
    return format_chat(exchanges(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


OP7_SQL = """
WITH c AS (SELECT *, conv_id % 6 AS mode, turn < 2 AS first FROM conversations),
m AS (
  SELECT conv_id, turn AS own, mode, role, text,
    turn + CASE WHEN role = 'user' AND mode = 1 AND first THEN 100 ELSE 0 END AS turn,
    CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
    CASE WHEN role = 'user' THEN 'call_' || conv_id || '_' || turn WHEN role = 'assistant' AND mode <> 5 THEN 'call_' || conv_id || '_' || (turn - 1) END AS call_id
  FROM c
  UNION ALL
  SELECT conv_id, turn, mode, role, text, turn + 50, 'result', 'call_' || conv_id || '_' || (turn - 1) FROM c WHERE role = 'assistant' AND mode = 2),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, call_id, kind ORDER BY turn) AS k FROM m),
a AS (SELECT conv_id, call_id, own, mode, turn FROM f WHERE kind = 'call' AND k = 1),
r AS (SELECT conv_id, call_id, turn FROM f WHERE kind = 'result' AND call_id IS NOT NULL AND k = 1),
chain AS (
  SELECT conv_id, call_id, own, mode, turn, CASE WHEN own < 2 THEN 0 WHEN NOT EXISTS (SELECT 1 FROM a b WHERE b.conv_id = a.conv_id AND b.own = a.own - 2) THEN 0 ELSE NULL END AS step FROM a),
w AS (
  SELECT conv_id, call_id, own, mode, turn,
    count(*) OVER (PARTITION BY conv_id, own % 2, grp ORDER BY own) - 1 AS step, first_value(turn) OVER (PARTITION BY conv_id, own % 2, grp ORDER BY own) AS head,
    first_value(own) OVER (PARTITION BY conv_id, own % 2, grp ORDER BY own) AS head_own, count(*) OVER (PARTITION BY conv_id, own % 2, grp) AS size
  FROM (SELECT *, count(step) OVER (PARTITION BY conv_id, own % 2 ORDER BY own) AS grp FROM chain)),
o AS (
  SELECT w.conv_id, w.call_id, w.mode = 3 AND head_own < 2 AND size > 1 AS cyclic,
    CASE WHEN NOT (w.mode = 3 AND head_own < 2 AND size > 1) AND w.turn <= head THEN head ELSE w.turn END AS at_turn,
    CASE WHEN NOT (w.mode = 3 AND head_own < 2 AND size > 1) AND w.turn <= head THEN 2 * step ELSE 0 END AS level, r.turn AS answer
  FROM w LEFT JOIN r ON r.conv_id = w.conv_id AND r.call_id = w.call_id),
s AS (
  SELECT f.*, CASE WHEN kind = 'message' THEN 'message' WHEN f.call_id IS NULL THEN 'malformed' WHEN f.k > 1 THEN 'duplicate'
      WHEN o.call_id IS NULL THEN 'orphan' WHEN o.answer IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
    o.at_turn, o.level, o.answer, o.cyclic
  FROM f LEFT JOIN o ON f.conv_id = o.conv_id AND f.call_id = o.call_id)
SELECT conv_id, turn, CAST(0 AS BIGINT) AS place, kind, call_id,
  CASE WHEN status IN ('linked', 'unanswered') AND cyclic THEN 'cyclic' ELSE status END AS status,
  CAST(CASE WHEN status NOT IN ('linked', 'unanswered') THEN turn WHEN kind = 'call' THEN at_turn WHEN answer > at_turn THEN answer ELSE at_turn END AS BIGINT) AS after_turn,
  CAST(CASE WHEN status NOT IN ('linked', 'unanswered') THEN 0 WHEN kind = 'call' THEN level WHEN answer > at_turn THEN 0 ELSE level + 1 END AS BIGINT) AS level,
  CASE WHEN kind <> 'call' THEN '' WHEN mode = 4 THEN 'prompt: not of type string; turn: not of type integer; note: unexpected' WHEN text IS NULL THEN 'prompt: missing' ELSE '' END AS errors,
  CAST(CASE
    WHEN kind = 'call' AND mode = 4 THEN json_object('arguments', json_object('note', 'x', 'prompt', own, 'turn', CAST(own AS VARCHAR)), 'id', call_id, 'name', 'reply', 'type', 'call')
    WHEN kind = 'call' THEN json_object('arguments', json_object('prompt', text, 'turn', own), 'id', call_id, 'name', 'reply', 'type', 'call')
    WHEN kind = 'result' AND mode = 5 THEN json_object('content', 'not JSON: ' || coalesce(text, ''), 'type', 'result')
    WHEN kind = 'result' THEN json_object('content', text, 'id', call_id, 'type', 'result')
    ELSE json_object('content', coalesce(text, ''), 'role', role, 'type', 'message') END AS VARCHAR) AS json
FROM s
"""
