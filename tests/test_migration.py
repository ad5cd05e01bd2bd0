"""Events of older formats against a plain rewriting."""

import json
import random

from tarnwork.operators import migration


class Broken(Exception):
    pass


def only(record, required, optional=()):
    return isinstance(record, dict) and set(record) <= {*required, *optional} and set(required) <= set(record)


def whole(x):
    return isinstance(x, int) and not isinstance(x, bool)


def plain(session, seq, kind, data, replaces, ids):
    own = f"legacy-message:{session}:{seq}"
    if not isinstance(data, dict):
        if kind == "steering/message":
            raise Broken(kind)
        return kind, data
    if kind == "turn/start" and "trigger" in data:
        t = data["trigger"]
        if not (whole(data.get("turn")) and data["turn"] >= 1 and only(data, ["turn", "trigger"]) and isinstance(t, dict) and isinstance(t.get("kind"), str) and t["kind"]):
            raise Broken(kind)
        return kind, {"turn": data["turn"]}
    if kind == "turn/end":
        r = data.get("reason")
        if not (whole(data.get("turn")) and data["turn"] >= 1 and only(data, ["turn", "reason"]) and isinstance(r, dict) and isinstance(r.get("kind"), str)):
            raise Broken(kind)
        k = r["kind"]
        if k in ("completed", "blocked", "max-tokens", "interrupted", "disposed") and set(r) != {"kind"}:
            raise Broken(kind)
        if k == "aborted" and "reason" not in r:
            if set(r) != {"kind"}:
                raise Broken(kind)
            return kind, {**data, "reason": {"kind": "aborted", "reason": {"kind": "legacy"}}}
        if k == "disposed":
            return kind, {**data, "reason": {"kind": "aborted", "reason": {"kind": "disposed"}}}
        if k == "error" and "error" not in r:
            f = r.get("failure")
            if not (whole(r.get("step")) and r["step"] >= 0):
                raise Broken(kind)
            if only(r, ["kind", "step", "failure"]) and only(f, ["message", "code"], ["status", "providerRetryAfterMs", "requestId"]) and isinstance(f["message"], str) and isinstance(f["code"], str) and isinstance(f.get("status", 0), int) and isinstance(f.get("requestId", ""), str):
                return kind, {**data, "reason": {"kind": "error", "error": f}}
            if not (only(r, ["kind", "step", "message"], ["code"]) and isinstance(r["message"], str) and isinstance(r.get("code", ""), str)):
                raise Broken(kind)
            return kind, {**data, "reason": {"kind": "error", "error": {"message": r["message"], "code": r.get("code", "UNKNOWN")}}}
        return kind, data
    if kind == "steering/message":
        if isinstance(data.get("message"), dict) and whole(data.get("turn")) and only(data, ["turn", "message"]):
            return "user/message", data["message"]
        if not (whole(data.get("turn")) and only(data, ["turn", "content", "source"])):
            raise Broken(kind)
        return "user/message", {"content": data["content"], "source": data["source"], "id": own, "role": "user"}
    if kind == "user/message" and not {"id", "role", "message"} & set(data) and {"content", "source"} <= set(data):
        return kind, {**data, "id": own, "role": "user"}
    if kind == "assistant/message" and "message" not in data and {"content", "provenance"} <= set(data):
        rest = {k: v for k, v in data.items() if k not in ("content", "provenance")}
        return kind, {**rest, "message": {"id": own, "role": "assistant", "content": data["content"], "source": {**data["provenance"], "kind": "model"}}}
    if kind == "tool/result" and "message" not in data and {"callId", "content", "isError"} <= set(data):
        rest = {k: v for k, v in data.items() if k not in ("callId", "content", "isError")}
        message = {"id": own if replaces is None else ids.get(replaces), "role": "user", "content": [{"type": "tool-result", "toolCallId": data["callId"], "content": data["content"], "isError": data["isError"]}], "source": {"kind": "tool", "callId": data["callId"]}}
        if message["id"] is None:
            del message["id"]
        return kind, {**rest, "message": message}
    return kind, data


def shapes(r):
    source, content = {"kind": "user"}, r.choice(['say "hi"', [{"type": "text", "text": "é\n"}], ""])
    return r.choice([
        ("steering/message", {"turn": 2, "message": {"id": "m1", "content": content}}), ("steering/message", {"turn": 1, "content": content, "source": source}), ("steering/message", {"turn": "x", "content": 1, "source": 2}), ("steering/message", {"content": 1}),
        ("turn/start", {"turn": 3, "trigger": {"kind": "user"}}), ("turn/start", {"turn": 3}), ("turn/start", {"turn": 0, "trigger": {"kind": "user"}}), ("turn/start", {"turn": 1, "trigger": {"kind": ""}}), ("turn/start", {"turn": 1, "trigger": 5, "more": 1}),
        ("turn/end", {"turn": 1, "reason": {"kind": r.choice(["completed", "blocked", "aborted", "disposed", "other"])}}), ("turn/end", {"turn": 1, "reason": {"kind": "completed", "x": 1}}), ("turn/end", {"turn": 1, "reason": {"kind": "aborted", "reason": {"kind": "user"}}}),
        ("turn/end", {"turn": 1, "reason": {"kind": "error", "step": 2, "message": "bad"}}), ("turn/end", {"turn": 1, "reason": {"kind": "error", "step": 2, "message": "bad", "code": "E1"}}), ("turn/end", {"turn": 1, "reason": {"kind": "error", "step": -1, "message": "bad"}}),
        ("turn/end", {"turn": 1, "reason": {"kind": "error", "step": 0, "failure": {"message": "m", "code": "c", "status": 500}}}), ("turn/end", {"turn": 1, "reason": {"kind": "error", "step": 0, "failure": {"message": "m", "code": 1}}}), ("turn/end", {"turn": 1, "reason": {"kind": "error", "error": {"a": 1}}}), ("turn/end", {"turn": 1}),
        ("user/message", {"content": content, "source": source, "extra": [1, {"a": None}]}), ("user/message", {"id": "u1", "role": "user", "content": content}), ("user/message", {"content": content}),
        ("assistant/message", {"content": content, "provenance": {"model": "m", "kind": "old"}, "turn": 4}), ("assistant/message", {"message": {"id": "a1"}}), ("tool/result", {"message": {"id": "t1"}}), ("other/event", {"x": 1}),
        *[("tool/result", {"callId": "c", "content": content, "isError": r.random() < 0.5, "step": 1})] * 8,
    ])


def test_migration_equals_a_plain_rewriting(spark):
    r = random.Random(8)
    rows, want = [], {}
    for session in range(12):
        ids = {}
        for seq in range(40):
            kind, data = shapes(r)
            replaces = r.randrange(seq) if seq and kind == "tool/result" and r.random() < 0.7 else None
            rows.append((session, seq, kind, json.dumps(data), replaces))
            try:
                new_kind, new = plain(session, seq, kind, data, replaces, ids)
                want[session, seq] = (new_kind, new, None)
                message = new if new_kind == "user/message" else new.get("message")
                if isinstance(message, dict) and isinstance(message.get("id"), str):
                    ids[seq] = message["id"]
            except Broken as e:
                want[session, seq] = (kind, data, str(e))
    rows.append((99, 0, "user/message", "not json", None))
    got = {(x["session_id"], x["seq"]): x for x in migration.migrated(spark.createDataFrame(rows, "session_id bigint, seq bigint, type string, data string, replaces bigint")).collect()}
    for k, (kind, data, problem) in want.items():
        x = got[k]
        assert (x["type"], json.loads(x["data"]), x["problem"]) == (kind, data, problem), (k, x, kind, data)
    assert got[99, 0]["data"] == "not json" and {p for _, _, p in want.values()} == {None, "steering/message", "turn/start", "turn/end"}
