from __future__ import annotations

import pytest

from cargolens.llm import chat_links

SCHEMA = {
    "type": "object",
    "properties": {"x": {"type": "integer", "minimum": 0, "maximum": 10**500}, "y": {"type": "number"}},
}


@pytest.mark.parametrize(
    "body, level, valid, status",
    [
        ('{"x":1' + "0" * 400 + "}", 0, True, "linked"),
        ('{"x":-1' + "0" * 400 + "}", 0, False, "linked"),
        ('{"x":2.0}', 0, True, "linked"),
        ('{"x":2.5}', 0, False, "linked"),
        ('{"y":true}', 0, False, "linked"),
        ('{"y":1e400}', None, False, "malformed"),
        ('{"x":' + "9" * 5000 + "}", None, False, "malformed"),
        ('{"x":' + "[" * 100_000 + "]" * 100_000 + "}", None, False, "malformed"),
    ],
)
def test_long_numbers_and_deep_nesting(spark, body, level, valid, status):
    text = f'<tool_call>{{"id":"a","name":"add","arguments":{body}}}</tool_call>'
    rows = [(1, 0, "assistant", text), (1, 1, "tool", '{"tool_call_id":"a","content":"done"}')]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = chat_links.link_tool_calls(messages, {"add": SCHEMA}).filter("kind = 'call'").first()
    assert (found["level"], found["valid"], found["status"]) == (level, valid, status)
