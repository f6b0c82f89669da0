from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from postlake.functions import images
from postlake.operators import chat_requests as cr, chat_responses as rs, chat_streams as st

NASTY = ["[x]", '"]"', "a\nb\t\\", "", "é😀", "[", "]", '{"a":[1]}']


def turns_of(spark, conversations):
    rows = [(c, n, role, text) for c, turns in conversations.items() for n, (role, text) in enumerate(turns)]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


CONVERSATIONS = {
    1: [("system", "be brief"), ("user", NASTY[0]), ("assistant", NASTY[1]), ("user", NASTY[2])],
    2: [("user", "only")],
    3: [("user" if n % 2 == 0 else "assistant", f"{n} {NASTY[n % 8]}") for n in range(11)],
    4: [("system", "s")] * 5 + [("user", "q")],
}


def request_of(turns):
    system = next((t for r, t in turns if r == "system"), None)
    return system, turns[:-1], turns[-1][1]


def openai_payload(turns):
    system, history, prompt = request_of(turns)
    lead = [{"role": "system", "content": system}] if system else []
    return {
        "model": "gpt-4o", "temperature": 0.7, "max_tokens": 9, "stream": False,
        "messages": lead + [{"role": r, "content": t} for r, t in history] + [{"role": "user", "content": prompt}],
    }


def gemini_payload(turns):
    system, history, prompt = request_of(turns)
    spoken = [("model" if r == "assistant" else r, t) for r, t in history if r != "system"] + [("user", prompt)]
    out = {"contents": [{"role": r, "parts": [{"text": t}]} for r, t in spoken],
           "generationConfig": {"temperature": 0.7, "maxOutputTokens": 9}}
    return {**out, "systemInstruction": {"parts": [{"text": system}]}} if system else out


@pytest.mark.parametrize("part_turns", [1 << 14, 3, 2, 1])
def test_payload_parts_join_to_the_whole(spark, part_turns):
    rows = cr.chat_requests(turns_of(spark, CONVERSATIONS), part_turns)
    args = (F.col("history"), F.col("prompt"), F.col("system_message"))
    bounds = {"max_tokens": 9, "first": F.col("part_no") == 0, "last": F.col("is_last")}
    out = rows.select(
        "conv_id", "part_no", cr.payload_openai(F.lit("gpt-4o"), *args, **bounds).alias("o"),
        cr.payload_gemini(*args, **bounds).alias("g")).orderBy("conv_id", "part_no").collect()
    for conv, turns in CONVERSATIONS.items():
        mine = [r for r in out if r["conv_id"] == conv]
        assert len(mine) == (len(turns) - 1) // part_turns + 1
        assert json.loads("".join(r["o"] for r in mine)) == openai_payload(turns)
        assert json.loads("".join(r["g"] for r in mine)) == gemini_payload(turns)


def test_history_order_and_parts(spark):
    history = cr.message_history(turns_of(spark, CONVERSATIONS), 4).orderBy("conv_id", "part_no").collect()
    for conv, turns in CONVERSATIONS.items():
        mine = [r for r in history if r["conv_id"] == conv]
        assert max(len(r["messages"]) for r in mine) <= 4
        assert [tuple(m) for r in mine for m in r["messages"]] == turns


def one_payload(spark, build):
    df = spark.range(1).select(
        F.array(F.struct(F.lit("tool").alias("role"), F.lit("x").alias("content"))).alias("h"))
    return json.loads(df.select(build(F.col("h"), F.lit("hi"))).first()[0])


def test_model_rules(spark):
    fixed = one_payload(spark, lambda h, p: cr.payload_openai(F.lit("o3"), h, p, max_tokens=5))
    assert fixed["max_completion_tokens"] == 5 and not {"temperature", "max_tokens"} & set(fixed)
    claude = one_payload(spark, lambda h, p: cr.payload_claude(F.lit("m"), h, p, system=F.lit("")))
    assert claude["max_tokens"] == 8096 and "system" not in claude and "stream" not in claude
    claude = one_payload(spark, lambda h, p: cr.payload_claude(
        F.lit("m"), h, p, system=F.lit("s"), max_tokens=7, stream=True))
    assert (claude["max_tokens"], claude["system"], claude["stream"]) == (7, "s", True)
    gemini = one_payload(spark, cr.payload_gemini)
    assert gemini["contents"] == [{"role": "user", "parts": [{"text": "hi"}]}]
    tools = F.lit('[{"function":{"name":"n","description":"d","parameters":{"b":1}}},{"type":"web"}]')
    gemini = one_payload(spark, lambda h, p: cr.payload_gemini(h, p, tools=tools))
    assert gemini["tools"] == [{"functionDeclarations": [
        {"name": "n", "description": "d", "parameters": {"b": 1}}]}]
    none = one_payload(spark, lambda h, p: cr.payload_gemini(h, p, tools=F.lit("[]")))
    assert "tools" not in none
    grok = one_payload(spark, lambda h, p: cr.payload_grok(F.lit("g"), h, p, tools=tools, stream=True))
    assert grok["tool_choice"] == "auto" and grok["stream"] is True and len(grok["tools"]) == 2
    shown = one_payload(spark, lambda h, p: cr.payload_claude(
        F.lit("m"), h, p, images=F.array(F.lit("data:image/gif;base64,R0lG"))))
    assert [c["type"] for c in shown["messages"][-1]["content"]] == ["image", "text"]


@pytest.mark.parametrize("image, kind", [
    ("/9j/4AAQSkZJRgABAQAA", "jpeg"), ("iVBORw0KGgoAAAANSUhE", "png"), ("R0lGODlhAQABAIAAAAAA", "gif"),
    ("UklGRgAAAABXRUJQVlA4", "webp"), ("a*cd", "png"), ("abc", "png"), ("data:image/webp;base64,/9j/4AAQ", "webp"),
    ("data:image/svg+xml;base64,AA", "svg+xml"),
])
def test_image_format(column, image, kind):
    assert column([image], images.image_extension) == [kind]
    assert column([image], images.image_mime) == [f"image/{kind}"]


def test_bodies(spark):
    bodies = {
        ("openai", '{"choices":[{"message":{"content":"a"}}]}'): ("a", None),
        ("openai", '{"choices":[]}'): (None, "Error parsing response"),
        ("grok", '{"error":null}'): (None, "Error: null"),
        ("claude", '{"content":[{"type":"text","text":"a"},{"type":"text","text":"b"}]}'): ("a", None),
        ("claude", '{"content":[]}'): (None, "No content in response"),
        ("gemini", '{"candidates":[{"content":{"parts":[{"text":"a"},{"x":1},{"text":"b"}]}}]}'): ("ab", None),
        ("gemini", '{"candidates":[]}'): (None, "No content in response"),
        ("gemini", "oops"): (None, "Error parsing response"),
    }
    rows = [(n, p, b) for n, (p, b) in enumerate(bodies)]
    df = spark.createDataFrame(rows, "request_id long, provider string, body string")
    found = rs.response_text(df).orderBy("request_id").collect()
    assert [(r["text"], r["error"]) for r in found] == list(bodies.values())
    failed = {r["request_id"]: r["error"] for r in rs.response_tool_calls(df).collect()}
    assert failed == {2: "Error: null", 7: "Error parsing response"}
    joined = rs.response_text(df, all_blocks=True).filter("request_id = 3").first()
    assert joined["text"] == "ab"


def lines_of(spark, requests):
    rows = [(r, n, line) for r, lines in requests.items() for n, line in enumerate(lines)]
    random.Random(5).shuffle(rows)
    return spark.createDataFrame(rows, "request_id long, line_no long, line string")


def parts_joined(df, *key, value):
    out: dict = {}
    for r in df.orderBy("part_no").collect():
        out.setdefault(tuple(r[k] for k in key), []).append(r[value])
    return {k: "".join(v) for k, v in out.items()}


@pytest.mark.parametrize("part_lines", [1 << 18, 4, 1])
def test_text_streams(spark, part_lines):
    rng = random.Random(part_lines)
    pieces = {r: [rng.choice(NASTY) for _ in range(rng.randrange(0, 14))] for r in range(6)}

    def delta(x):
        return "data: " + json.dumps({"choices": [{"delta": {"content": x}}]})

    def block(x):
        return "data: " + json.dumps({"type": "content_block_delta", "delta": {"type": "text_delta", "text": x}})

    def jsonl(x):
        return json.dumps({"candidates": [{"content": {"parts": [{"text": x}, {"functionCall": {"name": "f"}}]}}]})

    openai = {r: ["", "data: {bad"] + [delta(x) for x in p] + (["data:  [DONE] ", delta("late")] if r % 2 else [])
              for r, p in pieces.items()}
    claude = {r: ["event: x"] + [block(x) for x in p] + ['data: {"type": "message_stop"}', block("late")] * (r % 2)
              for r, p in pieces.items()}
    gemini = {r: ["[", "{}"] + [jsonl(x) for x in p] for r, p in pieces.items()}
    expected = {(r,): "".join(p) for r, p in pieces.items()}
    for lines, fn in ((openai, st.stream_text_delta), (claude, st.stream_text_blocks), (gemini, st.stream_text_jsonl)):
        found = fn(lines_of(spark, lines), part_lines)
        assert parts_joined(found, "request_id", value="text") == expected


def test_delta_calls(spark):
    def line(*calls):
        return "data: " + json.dumps({"choices": [{"delta": {"tool_calls": list(calls)}}]})
    lines = lines_of(spark, {
        1: [line({"index": 1, "id": "a", "function": {"name": "f"}}, {"id": "z", "function": {"name": "g"}}),
            line({"index": 1, "id": "", "function": {"arguments": '{"x":'}}),
            line({"index": 1, "id": "b", "function": {"name": "", "arguments": "1}"}}, {"function": {"arguments": "{"}}),
            "data: [DONE]", line({"index": 1, "id": "late"})],
        2: ["data: [DONE]"],
    })
    found = {(r["request_id"], r["call_index"]): (r["id"], r["name"], r["arguments"])
             for r in st.stream_tool_calls_delta(lines).collect()}
    assert found == {(1, 1): ("b", "f", '{"x":1}'), (1, 0): ("z", "g", "{}")}


def test_block_calls_follow_the_open_block(spark):
    def start(i, kind="tool_use", **more):
        return "data: " + json.dumps({"type": "content_block_start", "index": i, "content_block": {"type": kind, **more}})

    def piece(text, i=0):
        return "data: " + json.dumps({"type": "content_block_delta", "index": i,
                                      "delta": {"type": "input_json_delta", "partial_json": text}})
    lines = lines_of(spark, {1: [
        piece("lost"), start(0, "text"), piece("lost"), start(1, id="a", name="f"), piece('{"x":', 5),
        start(2, id="b", name="g"), piece('{"y":2}', 1), start(1, id="a2", name="f2"), piece('{"z":3}', 9),
        start(3, id="c", name="h"), piece("{bad"), 'data: {"type":"message_stop"}', piece("late")]})
    found = {r["block_index"]: (r["id"], r["name"], r["arguments"])
             for r in st.stream_tool_calls_blocks(lines).collect()}
    assert found == {1: ("a2", "f2", '{"z":3}'), 2: ("b", "g", '{"y":2}'), 3: ("c", "h", "{}")}


@pytest.mark.parametrize("part_lines", [1 << 18, 4, 3, 2, 1])
def test_calls_do_not_depend_on_parts(spark, part_lines):
    text = json.dumps({"x": list(range(30))}, separators=(",", ":"))
    pieces = [text[n:n + 5] for n in range(0, len(text), 5)]

    def start(index, kind="tool_use", **more):
        return "data: " + json.dumps({"type": "content_block_start", "index": index, "content_block": {"type": kind, **more}})

    def json_piece(p):
        return "data: " + json.dumps({"type": "content_block_delta", "delta": {"type": "input_json_delta", "partial_json": p}})

    blocks = [json_piece("lost"), start(9, "text"), json_piece("lost"), start(4, id="old", name="old"), json_piece('{"old":1}'),
              start(5, id="c", name="bad"), json_piece('{"x":'), json_piece("1, bad }"), start(4, id="a", name="f"),
              *map(json_piece, pieces), 'data: {"type":"message_stop"}', json_piece("late")]
    found = st.stream_tool_calls_blocks(lines_of(spark, {1: blocks}), part_lines).collect()
    assert {(r["block_index"], r["id"], r["name"], r["arguments"]) for r in found} == {
        (4, "a", "f", text), (5, "c", "bad", "{}")}

    def delta(**call):
        return "data: " + json.dumps({"choices": [{"delta": {"tool_calls": [call]}}]})

    deltas = [delta(index=4, id="a", function={"name": "f"}), *[delta(index=4, function={"arguments": p}) for p in pieces],
              delta(index=4, id="z"), delta(index=1, function={"arguments": '{"x":'}), delta(index=1, function={"arguments": "1, bad }"}),
              "data: [DONE]", delta(index=4, id="late")]
    found = st.stream_tool_calls_delta(lines_of(spark, {1: deltas}), part_lines).collect()
    assert {(r["call_index"], r["id"], r["name"], r["arguments"]) for r in found} == {(4, "z", "f", text), (1, "", "", "{}")}


def test_sparse_and_repeated_turns(spark):
    rows = [(1, 5, "user", "a"), (1, 5_000_000, "user", "b"), (2, 0, "system", "s"), (2, 7, "assistant", "x"), (2, 7, "user", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = cr.chat_requests(df, 2).orderBy("conv_id", "part_no").collect()
    assert [(r["conv_id"], r["part_no"], r["n_parts"], r["is_last"]) for r in found] == [
        (1, 0, 2, False), (1, 1, 2, True), (2, 0, 2, False), (2, 1, 2, True)]
    assert [r["prompt"] for r in found] == [None, "b", None, "y"]
    assert [[m["content"] for m in r["history"]] for r in found] == [["a"], [], ["s"], ["x"]]


def test_calls_of_one_name_merge(spark):
    def line(*calls):
        return json.dumps({"candidates": [{"content": {"parts": [{"functionCall": c} for c in calls]}}]})
    lines = lines_of(spark, {1: [
        line({"name": "f", "args": {"b": 1}}, {"name": "g"}), '{"candidates":[{"content":{"parts":[{"text":"t"}]}}]}',
        line({"name": "f", "args": {"a": {"k": [1, "x"]}, "b": 2}}), "oops", line({"name": "f", "args": {"b": "3]"}})]})
    found = {r["name"]: (r["id"], r["first_line"], json.loads(r["arguments"]))
             for r in st.stream_tool_calls_merge(lines).collect()}
    assert found == {"f": ("f", 0, {"b": "3]", "a": {"k": [1, "x"]}}), "g": ("g", 0, {})}
