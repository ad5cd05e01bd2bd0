"""Rewriting of stored events of older formats.

Events are (session_id, seq, type, data, replaces): ``data`` is a JSON object, ``replaces`` the position
that a replacing event names, if it does.  What looks neither old nor broken stays as it is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.operators import lineage
from tarnwork.storage import stored

#: Ends of turns that say nothing but their kind, and the parts of an old failure.
PLAIN_ENDS = ("completed", "blocked", "max-tokens", "interrupted")
FAILURE, FAILURE_MORE = ("message", "code"), ("status", "providerRetryAfterMs", "requestId")


def _json(path: str) -> Column:
    """The JSON text of a part of the event's data, null if it is not there."""
    return F.to_json(F.expr(f"try_variant_get(v, '$.{path}', 'variant')"))


def _string(path: str) -> Column:
    """A part that is a string, else null."""
    return F.when(F.substring(_json(path), 1, 1) == '"', F.expr(f"try_variant_get(v, '$.{path}', 'string')"))


def _number(path: str) -> Column:
    """A part that is a number, else null."""
    return F.when(_json(path).rlike(r"^-?[0-9]"), F.expr(f"try_variant_get(v, '$.{path}', 'double')"))


def _whole(path: str) -> Column:
    """Whether a part is a whole number."""
    return F.coalesce(_json(path).rlike(r"^-?[0-9]+$"), F.lit(False))


def _keys(path: str = "") -> Column:
    return F.coalesce(F.json_object_keys(_json(path) if path else F.col("data")), F.array().cast("array<string>"))


def _has(key: str) -> Column:
    return F.array_contains(_keys(), key)


def _only(path: str, required: tuple[str, ...], optional: tuple[str, ...] = ()) -> Column:
    """Whether a part is an object of the required members and no others but optional ones."""
    keys = _keys(path)
    return (F.size(F.array_except(keys, F.array(*map(F.lit, (*required, *optional))))) == 0) & reduce(lambda a, k: a & F.array_contains(keys, k), required, F.lit(True))


def _object(**members: Column) -> Column:
    """JSON of an object of those members (JSON texts) that are not null."""
    return F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), c) for k, c in members.items())), F.lit("}"))


def _text(c: Column | str) -> Column:
    return F.concat(F.lit('"'), F.lit(c) if isinstance(c, str) else c, F.lit('"'))


def _rest(*dropped: str) -> Column:
    """The other members of the data, as JSON with a comma behind each."""
    kept = F.filter(_keys(), lambda k: ~k.isin(*dropped))
    return F.coalesce(F.array_join(F.transform(kept, lambda k: F.concat(F.lit('"'), k, F.lit('":'), F.col("members")[k], F.lit(","))), ""), F.lit(""))


def migrated(events: DataFrame) -> DataFrame:
    """(session_id, seq, type, data, problem): every event in the present format; ``problem`` names broken old ones, whose data stay.

    Messages without an identity get one from their place; a tool's result that replaces a message
    takes over the identity of what it replaces, however often that was replaced before.
    """
    rows = events.withColumn("v", F.try_parse_json("data")).withColumn("members", F.expr("transform_values(cast(v as map<string, variant>), (k, x) -> to_json(x))"))
    own_id = F.concat(F.lit("legacy-message:"), F.col("session_id").cast("string"), F.lit(":"), F.col("seq").cast("string"))
    kind = F.col("type")
    record = F.coalesce(F.startswith(F.ltrim("data"), F.lit("{")), F.lit(False)) & F.col("v").isNotNull()
    # a message of its own in each of the three kinds
    steering = kind == "steering/message"
    wrapped = steering & F.coalesce(F.startswith(_json("message"), F.lit("{")), F.lit(False)) & _whole("turn") & _only("", ("turn", "message"))
    bare = steering & _whole("turn") & _only("", ("turn", "content", "source"))
    user = (kind == "user/message") & ~_has("id") & ~_has("role") & ~_has("message") & _has("content") & _has("source")
    assistant = (kind == "assistant/message") & ~_has("message") & _has("content") & _has("provenance")
    result = (kind == "tool/result") & ~_has("message") & _has("callId") & _has("content") & _has("isError")
    # turns
    started = (kind == "turn/start") & _has("trigger")
    start_well = _whole("turn") & (_number("turn") >= 1) & _only("", ("turn", "trigger")) & (F.length(_string("trigger.kind")) > 0)
    ended, why = (kind == "turn/end") & record, _string("reason.kind")
    end_well = _whole("turn") & (_number("turn") >= 1) & _only("", ("turn", "reason")) & why.isNotNull()
    alone = _only("reason", ("kind",))
    failure = _only("reason", ("kind", "step", "failure")) & _only("reason.failure", FAILURE, FAILURE_MORE) & _string("reason.failure.message").isNotNull() & _string("reason.failure.code").isNotNull()
    failure = failure & (_json("reason.failure.status").isNull() | _number("reason.failure.status").isNotNull()) & (_json("reason.failure.providerRetryAfterMs").isNull() | _number("reason.failure.providerRetryAfterMs").isNotNull()) & (_json("reason.failure.requestId").isNull() | _string("reason.failure.requestId").isNotNull())
    told = _only("reason", ("kind", "step", "message"), ("code",)) & _string("reason.message").isNotNull() & (_json("reason.code").isNull() | _string("reason.code").isNotNull())
    stepped = _whole("reason.step") & (_number("reason.step") >= 0)
    old_abort, old_error = (why == "aborted") & ~F.array_contains(_keys("reason"), "reason"), (why == "error") & ~F.array_contains(_keys("reason"), "error")
    error = F.when(failure, _json("reason.failure")).otherwise(_object(message=_json("reason.message"), code=F.coalesce(_json("reason.code"), F.lit('"UNKNOWN"'))))
    reason = (
        F.when(old_abort & alone, F.lit('{"kind":"aborted","reason":{"kind":"legacy"}}')).when((why == "disposed") & alone, F.lit('{"kind":"aborted","reason":{"kind":"disposed"}}'))
        .when(old_error & stepped & (failure | told), _object(kind=F.lit('"error"'), error=error))
    )
    broken_end = ~end_well | (why.isin(*PLAIN_ENDS, "disposed") & ~alone) | (old_abort & ~alone) | (old_error & ~(stepped & (failure | told)))
    bad = lambda c: F.coalesce(c, F.lit(True))
    problem = F.when(steering & bad(~(wrapped | bare)), "steering/message").when(started & bad(~start_well), "turn/start").when(ended & bad(broken_end), "turn/end")
    source = F.concat(F.lit("{"), F.array_join(F.transform(F.filter(_keys("provenance"), lambda k: k != "kind"), lambda k: F.concat(F.lit('"'), k, F.lit('":'), F.col("provenance")[k], F.lit(","))), ""), F.lit('"kind":"model"}'))
    rows = rows.withColumn("provenance", F.expr("transform_values(try_variant_get(v, '$.provenance', 'map<string, variant>'), (k, x) -> to_json(x))"))
    parts = rows.select(
        "session_id", "seq", "type", "data", "replaces", problem.alias("problem"), own_id.alias("own_id"), (result & F.col("replaces").isNotNull()).alias("inherits"),
        F.when(wrapped | (bare | user), F.when(wrapped, _string("message.id")).otherwise(own_id)).when(assistant | result, own_id).when(kind == "user/message", _string("id")).otherwise(_string("message.id")).alias("message_id"),
        F.when(problem.isNotNull(), F.col("data")).when(wrapped, _json("message")).when(bare, _object(content=_json("content"), source=_json("source"), id=_text(own_id), role=F.lit('"user"')))
        .when(user, F.concat(F.lit("{"), _rest("id"), F.lit('"id":'), _text(own_id), F.lit(',"role":"user"}')))
        .when(assistant, F.concat(F.lit("{"), _rest("content", "provenance"), F.lit('"message":'), _object(id=_text(own_id), role=F.lit('"assistant"'), content=_json("content"), source=source), F.lit("}")))
        .when(started, _object(turn=_json("turn"))).when(ended & reason.isNotNull(), _object(turn=_json("turn"), reason=reason)).alias("new"),
        F.when(result, F.concat(F.lit("{"), _rest("callId", "content", "isError"), F.lit('"message":'))).alias("head"),
        _object(role=F.lit('"user"'), content=F.concat(F.lit("["), _object(type=F.lit('"tool-result"'), toolCallId=_json("callId"), content=_json("content"), isError=_json("isError")), F.lit("]")), source=_object(kind=F.lit('"tool"'), callId=_json("callId"))).alias("tail"),
        F.when(wrapped | bare, "user/message").otherwise(kind).alias("new_type"),
    )
    parts = stored(parts, "migrated-events")
    node = lambda seq: F.struct("session_id", F.col(seq).alias("seq"))
    taken = lineage.roots(parts.select(node("seq").alias("id"), F.when(F.col("inherits"), node("replaces")).alias("parent")))
    first = parts.select(node("seq").alias("root"), F.col("message_id").alias("root_id"), F.col("inherits").alias("root_inherits"))
    ids = taken.join(first, "root", "left").select("id.session_id", "id.seq", F.when(~F.col("root_inherits"), F.col("root_id")).alias("taken_id"))
    whole = parts.join(ids, ["session_id", "seq"], "left")
    message = F.concat(F.col("head"), F.lit("{"), F.coalesce(F.concat(F.lit('"id":'), _text(F.when(F.col("inherits"), F.col("taken_id")).otherwise(F.col("own_id"))), F.lit(",")), F.lit("")), F.expr("substring(tail, 2)"), F.lit("}"))
    return whole.select("session_id", "seq", F.col("new_type").alias("type"), F.coalesce("new", F.when(F.col("problem").isNull(), message), F.col("data")).alias("data"), "problem")
