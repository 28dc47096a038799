import json

from tessera.llm import chat
from tessera.llm.chat import canonical, format_chat, violations

SCHEMA = {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer", "minimum": 1}, "k": {"enum": ["a", "b"]}, "l": {"type": "array", "items": {"type": "string"}, "maxItems": 2}}, "additionalProperties": False}


def _call(**c):
    return f"<tool_call>{json.dumps(c)}</tool_call>"


def _result(of, content):
    return json.dumps({"tool_call_id": of, "content": content})


def test_canonical_and_violations():
    assert canonical({"b": 1.0, "a": [True, None, "é\n"], "c": 0.5}) == '{"a":[true,null,"é\\n"],"b":1,"c":0.5}'
    assert violations({"x": 2, "k": "a", "l": ["p"]}, SCHEMA) == []
    assert violations({"k": "z", "l": [1, "b", "c"], "y": 0}, SCHEMA) == ["$.x: missing", "$.k: not in enum", "$.l: too long", "$.l[0]: not of type string", "$.y: not allowed"]
    assert violations({"x": True}, SCHEMA) == ["$.x: not of type integer"]
    assert violations({"x": 0}, SCHEMA) == ["$.x: too small"]


def test_links_order_and_validation(spark):
    rows = [
        (1, 0, "system", 'Be brief.<tools>[{"name":"f","parameters":' + json.dumps(SCHEMA) + "}]</tools>"),
        (1, 1, "tool", _result("c1", {"b": 1, "a": 2})),
        (1, 2, "user", "go"),
        (1, 3, "assistant", "ok " + _call(id="c1", name="f", arguments={"x": 3}) + _call(id="c2", name="f", arguments={"x": 0})),
        (1, 4, "tool", _result("c2", "plain")),
        (1, 5, "tool", _result("c9", "lost")),
        (1, 6, "assistant", _call(id="c1", name="g", arguments="{}") + "<tool_call>nothing</tool_call>"),
        (2, 0, "user", None),
        (2, 0, "user", "ü <tool_call>open"),
        (None, 0, None, "text"),
        (None, None, None, None),
    ]
    got = format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("position", chat.F.lit("clash"))).collect()
    assert len(got) == len(rows)
    one = sorted((r for r in got if r["conv_id"] == 1), key=lambda r: r["position"])
    assert [r["turn"] for r in one] == [0, 2, 3, 1, 4, 5, 6]
    assert [r["position"] for r in one] == list(range(7))
    assert one[0]["message"] == '{"content":"Be brief.","role":"system"}'
    assert one[2]["message"] == '{"content":"ok ","role":"assistant","tool_calls":[{"arguments":{"x":3},"id":"c1","name":"f"},{"arguments":{"x":0},"id":"c2","name":"f"}]}'
    assert (one[2]["n_calls"], one[2]["n_invalid"], one[2]["error"]) == (2, 1, "$.x: too small")
    assert one[3]["message"] == '{"content":"{\\"a\\":2,\\"b\\":1}","role":"tool","tool_call_id":"c1"}' and one[3]["answers_turn"] == 3
    assert [r["error"] for r in one[4:6]] == [None, "orphan"]
    assert (one[6]["n_calls"], one[6]["n_invalid"], one[6]["error"]) == (2, 2, "unknown tool g")
    two = sorted((r["position"], r["message"]) for r in got if r["conv_id"] == 2)
    assert two == [(0, '{"content":null,"role":"user"}'), (1, '{"content":"ü <tool_call>open","role":"user"}')]
    assert sorted(r["position"] for r in got if r["conv_id"] is None) == [0, 1]


def test_long_conversation_is_spread_and_numbered(spark):
    rows = [(7, i, "user", f"m{i}") for i in range(3000)] + [(i + 10, 0, "user", "x") for i in range(20)]
    got = format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)).collect()
    assert sorted((r["turn"], r["position"]) for r in got if r["conv_id"] == 7) == [(i, i) for i in range(3000)]
    assert format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
