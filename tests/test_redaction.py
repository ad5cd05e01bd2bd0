"""The redaction waterfall against a plain walk."""

import json
import random
import re

from tarnwork.operators import redaction


def walk(value, key=None):
    """(redacted value, hits) by walking a parsed record."""
    for rule in redaction.RULES:
        if rule.key is not None and (key is None or not re.search(rule.key, key)):
            continue
        if rule.text is not None and not (isinstance(value, str) and re.search(rule.text, value)):
            continue
        return (re.sub(rule.text, rule.put, value) if rule.inside else rule.put), 1
    if isinstance(value, dict):
        made = {k: walk(v, k) for k, v in value.items()}
        return {k: v for k, (v, _) in made.items()}, sum(n for _, n in made.values())
    if isinstance(value, list):
        made = [walk(v) for v in value]
        return [v for v, _ in made], sum(n for _, n in made)
    return value, 0


def record(r, depth=0):
    x = r.random()
    if depth < 4 and x < 0.4:
        return {r.choice(["a", "b c", 'q"uote', "token", "api_key", "Password", "tokens", "é"]) + r.choice(["", "", "1"]): record(r, depth + 1) for _ in range(r.randint(0, 4))}
    if depth < 4 and x < 0.6:
        return [record(r, depth + 1) for _ in range(r.randint(0, 12))]
    return r.choice([None, True, 12, -3, "plain", "Bearer abc.def", "mail bob@x.org and Bearer zz", 'with "quotes" \\ and\nlines', "", "é数", "a@b.c"])


def test_redaction_equals_a_walk(spark):
    r = random.Random(4)
    bodies = [record(r) for _ in range(120)]
    rows = [(k, json.dumps(b)) for k, b in enumerate(bodies)] + [(900, "not json"), (901, None), (902, "{}"), (903, '"x@y.de"')]
    got = {x["id"]: (x["json"], x["hits"]) for x in redaction.redact(spark.createDataFrame(rows, "id bigint, body string")).collect()}
    for k, body in [*enumerate(bodies), (902, {}), (903, "x@y.de")]:
        want, hits = walk(body)
        assert json.loads(got[k][0]) == want and got[k][1] == hits, (body, got[k])
    assert got[900] == got[901] == (None, 0)
    assert redaction.redact(spark.createDataFrame([], "id bigint, body string")).count() == 0


def test_rules_of_the_caller_come_first(spark):
    rules = (redaction.Rule("phone", None, r"\+[0-9]+", "[phone]", True), *redaction.RULES)
    got = redaction.redact(spark.createDataFrame([(1, '{"token": "+123", "n": "+49 a@b.c"}')], "id int, body string"), rules).first()
    assert json.loads(got["json"]) == {"token": "[phone]", "n": "[phone] a@b.c"} and got["hits"] == 2
