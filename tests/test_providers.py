"""Provider streams: goldens made by hand, batch against stateful fold."""

import json
from collections import namedtuple

import pytest
from pyspark.sql import functions as F

from corpusmill.streaming import providers as P
from corpusmill.streaming.fold import ordered_fold, ordered_fold_stream

Raw = namedtuple("Raw", "payload")
Event = namedtuple("Event", [c.split()[0] for c in P.EVENT.split(", ")])


def run(machine, payloads):
    out = []
    for p in payloads:
        out += machine.feed(Raw(p if isinstance(p, str) or p is None else json.dumps(p)))
    return [Event(*x) for x in out + machine.close()]


def kinds(events):
    return [(e.kind, e.text) if e.text is not None else e.kind for e in events]


def test_messages():
    start = lambda **b: {"type": "content_block_start", "content_block": b}
    delta = lambda **b: {"type": "content_block_delta", "delta": b}
    stop = {"type": "content_block_stop"}
    got = run(P.Messages(), [
        {"type": "message_start"}, start(type="thinking"), delta(type="thinking_delta", thinking="a"), delta(type="signature_delta", signature="s"), stop, start(type="redacted_thinking", data="x"), stop, start(type="text"),
        delta(type="text_delta", text="hi"), stop, start(type="tool_use", name="t", id="1"), stop, start(type="tool_use", name="t", id="2"), delta(type="input_json_delta", partial_json='{"a":1}'), stop, "no json", None, {"type": "new"},
        {"type": "message_stop", "amazon-bedrock-invocationMetrics": {"inputTokenCount": 5, "cacheReadInputTokenCount": 2}},
    ])
    assert kinds(got) == ["thinking_start", ("thinking_delta", "a"), ("thinking_end", "s"), ("redacted", "x"), "text_start", ("text_delta", "hi"), "text_end", "tool_start", ("tool_delta", "{}"), "tool_end", "tool_start", ("tool_delta", '{"a":1}'), "tool_end", "usage"]
    assert got[-1][4:] == (5, 0, 2, 0) and (got[7].tool_name, got[7].tool_use_id) == ("t", "1")


def test_responses():
    got = run(P.Responses(), [{"type": "response.output_item.added", "item": {"type": "function_call", "name": "f", "call_id": "c"}}, {"type": "response.function_call_arguments.delta", "delta": "{}"}, {"type": "response.function_call_arguments.done"}, {"type": "response.completed", "response": {"usage": {"input_tokens": 9, "output_tokens": 4, "input_tokens_details": {"cached_tokens": 3}}}}])
    assert kinds(got) == ["tool_start", ("tool_delta", "{}"), "tool_end", "usage"] and got[-1][4:] == (6, 4, 3, None)


def test_candidates():
    chunk = lambda *parts, **c: {"candidates": [{"content": {"parts": list(parts)}, **c}]}
    got = run(P.Candidates(), [chunk({"text": "a"}, {"text": "b"}), chunk({"function_call": {"name": "f", "id": "1", "args": {"x": 1}}}, {"function_call": {"name": "g", "args": "plain"}}), chunk({"text": "c"}, finish_reason="STOP")])
    assert kinds(got) == ["text_start", ("text_delta", "a"), ("text_delta", "b"), "text_end", "tool_start", ("tool_delta", '{"x": 1}'), "tool_end", "tool_start", ("tool_delta", '{"value": "plain"}'), "tool_end", "text_start", ("text_delta", "c"), "text_end"]
    assert kinds(run(P.Candidates(), [{"candidates": [{"finish_reason": "MALFORMED_FUNCTION_CALL"}]}])) == [("malformed", "No message provided")]


def test_choices():
    chunk = lambda finish=None, **d: {"choices": [{"delta": d, "finish_reason": finish}]}
    call = lambda i=None, n=None, a=None: {"id": i, "function": {"name": n, "arguments": a}}
    got = run(P.Choices(), [
        chunk(reasoning="r"), chunk(reasoning_details=[{"type": "reasoning.encrypted"}]), chunk(content="t"), chunk(tool_calls=[call("1", "f", "{")]), chunk(tool_calls=[call(a="}")]), chunk(reasoning="late"), chunk(tool_calls=[call("2", "g")]), chunk(content="late"),
    ])
    assert kinds(got) == ["thinking_start", ("thinking_delta", "r"), ("thinking_end", ""), "text_start", ("text_delta", "t"), "text_end", "tool_start", ("tool_delta", "{"), ("tool_delta", "}"), "tool_end", "tool_start", "tool_end"]
    assert kinds(run(P.Choices(), [chunk(content="open")])) == ["text_start", ("text_delta", "open"), "text_end"]


def test_blocks():
    feed = lambda *events: [r for b in [P.Blocks()] for e in events for r in b.feed(Event(*e))]
    e = P.event
    assert feed(e("text_delta", "x"), e("text_start"), e("text_delta", "lost"), e("text_start"), e("text_delta", "a"), e("tool_delta", "no"), e("text_delta", "b"), e("text_end"), e("text_end")) == [(1, "text", "ab", None, None, None)]
    assert feed(e("tool_start", None, "f", "1"), e("tool_end"), e("tool_start", None, "f", "2"), e("tool_delta", '{"a": [1, "é"]}'), e("tool_end")) == [(1, "tool", None, "f", "1", "{}"), (2, "tool", None, "f", "2", '{"a":[1,"é"]}')]
    assert feed(e("tool_start", None, "f", "1"), e("tool_delta", "{"), e("tool_end"), e("redacted", "z"), e("thinking_start"), e("thinking_delta", "never ended")) == [(1, "tool", None, "f", "1", None), (2, "redacted", "z", None, None, None)]


def test_pairing(spark):
    """A response takes the head of the line after those before it have left; one without a request empties the line."""
    rows = [("s", 1, "request", "a"), ("s", 2, "request", "b"), ("s", 3, "request", "c"), ("s", 4, "response", "b"), ("s", 5, "response", "a"), ("s", 6, "response", "c"), ("s", 7, "request", "d"), ("s", 8, "response", "d"), (None, 9, "response", "d"), ("t", 3, "response", "a")]
    df = spark.createDataFrame(rows, "session string, id bigint, kind string, tool_use_id string").repartition(3)
    got = {(r["response"], r["request"]) for r in ordered_fold(df, "session", ["id"], P.Pairing, P.Pairing.SCHEMA).where("session = 's'").collect()}
    assert got == {(4, 2), (5, None), (6, None), (8, 7)}
    assert ordered_fold(df.limit(0), "session", ["id"], P.Pairing, P.Pairing.SCHEMA).count() == 0


@pytest.mark.parametrize("cut", [1, 3])
def test_batch_and_stateful_fold_agree(spark, tmp_path, cut):
    payloads = [{"type": "content_block_start", "content_block": {"type": "text"}}, {"type": "content_block_delta", "delta": {"type": "text_delta", "text": "ab"}}, {"type": "content_block_stop"}, {"type": "content_block_start", "content_block": {"type": "tool_use", "name": "f", "id": "1"}}, {"type": "content_block_stop"}, {"type": "message_stop"}]
    rows = [(s, i, json.dumps(p)) for i, p in enumerate(payloads) for s in ("x", "y")]
    df = spark.createDataFrame(rows, "stream string, seq int, payload string")
    batch = sorted(map(tuple, ordered_fold(df, "stream", ["seq"], P.Messages, P.EVENT).collect()))
    for i in range(0, len(rows), 4 * cut):
        spark.createDataFrame(rows[i : i + 4 * cut], df.schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = ordered_fold_stream(src, "stream", "seq", P.Messages, P.EVENT, ends=lambda r: "message_stop" in r.payload)
    q = out.writeStream.format("memory").queryName(f"folded{cut}").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(map(tuple, spark.table(f"folded{cut}").collect()), key=str) == sorted(batch, key=str) and len(batch) == 14
    assert spark.table(f"folded{cut}").where(F.col("kind") == "tool_delta").first()["text"] == "{}"
