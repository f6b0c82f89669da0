"""CH: chat requests, recorded responses and recorded streams.

Recorded bodies and lines are made from the given conversations, so what comes out
must equal the text that went in.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from postlake.functions import images as im
from postlake.functions.jsontext import as_json, json_object
from postlake.operators import chat_requests as cr
from postlake.operators import chat_responses as rs
from postlake.operators import chat_streams as st
from postlake.plans import inputs as i
from postlake.plans.registry import query

MAX_TOKENS = 256
PROVIDERS = ["openai", "grok", "claude", "gemini"]
OPENAI_MODEL = "CASE conv_id % 3 WHEN 0 THEN 'gpt-4o-mini' WHEN 1 THEN 'o3-mini' ELSE 'gpt-5' END"
TOOLS = [{
    "type": "function",
    "function": {
        "name": "estimate_pay", "description": "Pay for a title",
        "parameters": {"type": "object", "properties": {"title": {"type": "string"}}},
    },
}]
TOOLS_JSON = json.dumps(TOOLS, separators=(",", ":"))
GEMINI_TOOLS_JSON = json.dumps(
    [{"functionDeclarations": [TOOLS[0]["function"]]}], separators=(",", ":"))


def turns(spark, sf_dir):
    return i.table(spark, sf_dir, "conversations")


def requests(spark, sf_dir, part_turns=cr.PART_TURNS):
    """Payload inputs, a row per part."""
    return cr.chat_requests(turns(spark, sf_dir), part_turns).withColumn("model", F.expr(OPENAI_MODEL))


# --- CH1-CH6 -------------------------------------------------------------------

REQUESTS = f"""
SELECT conv_id, {OPENAI_MODEL} AS model, arg_max(text, turn) AS prompt,
  arg_min(text, turn) FILTER (role = 'system') AS system_message,
  list({{'role': role, 'content': text}} ORDER BY turn)[1:-2] AS history
FROM conversations GROUP BY conv_id
"""
USER = "[{'role': 'user', 'content': prompt}]"
SYSTEM = "CASE WHEN system_message IS NULL THEN [] ELSE [{'role': 'system', 'content': system_message}] END"
LED = f"CAST(to_json(list_concat(list_concat({SYSTEM}, history), {USER})) AS VARCHAR)"
PLAIN = f"CAST(to_json(list_concat(history, {USER})) AS VARCHAR)"
FIXED = "model IN ('o3-mini', 'gpt-5')"


def _text(column):
    return f"CAST(to_json({column}) AS VARCHAR)"


GEMINI_CONTENTS = """
'{"contents":' || CAST(to_json(list_concat(
  list_transform(list_filter(history, lambda m: m.role IN ('user', 'assistant')),
    lambda m: {'role': CASE WHEN m.role = 'assistant' THEN 'model' ELSE 'user' END, 'parts': [{'text': m.content}]}),
  [{'role': 'user', 'parts': [{'text': prompt}]}])) AS VARCHAR)
  || ',"generationConfig":{"temperature":0.7,"maxOutputTokens":256}'
  || CASE WHEN system_message IS NULL THEN '' ELSE
     ',"systemInstruction":{"parts":[{"text":' || CAST(to_json(system_message) AS VARCHAR) || '}]}' END
"""
SYSTEM_TAIL = f"CASE WHEN system_message IS NULL THEN '' ELSE ',\"system\":' || {_text('system_message')} END"
OPENAI_TAIL = f"CASE WHEN {FIXED} THEN ',\"max_completion_tokens\":256' ELSE ',\"temperature\":0.7,\"max_tokens\":256' END"


def _payload_sql(expr):
    return i.with_views(f"""
SELECT conv_id, CAST(0 AS BIGINT) AS part_no, CAST(1 AS BIGINT) AS n_parts, {expr} AS payload FROM requests""",
        requests=REQUESTS)


SMALL_PARTS = 2
PARTS = f"SELECT conv_id, count(DISTINCT turn // {SMALL_PARTS}) AS n_parts FROM conversations GROUP BY conv_id"


def _payload_query(name, build, expr):
    """The payload under `name`, and again with parts of two turns, put together by part_no."""
    @query(name, _payload_sql(expr))
    def whole(spark, sf_dir):
        return _payload(spark, sf_dir, build, cr.PART_TURNS)

    @query(f"{name}_parts", i.with_views(
        f"SELECT conv_id, n_parts, {expr} AS payload FROM requests JOIN parts USING (conv_id)",
        requests=REQUESTS, parts=PARTS))
    def parts(spark, sf_dir):
        rows = _payload(spark, sf_dir, build, SMALL_PARTS)
        listed = F.array_sort(F.collect_list(F.struct("part_no", "payload")))
        return rows.groupBy("conv_id", "n_parts").agg(
            F.array_join(F.transform(listed, lambda x: x["payload"]), "").alias("payload"))


@query("ch1_message_history", """
SELECT conv_id, CAST(0 AS BIGINT) AS part_no, CAST(1 AS BIGINT) AS n_parts,
  CAST(to_json(list({'role': role, 'content': text} ORDER BY turn)) AS VARCHAR) AS messages
FROM conversations GROUP BY conv_id""")
def ch1(spark, sf_dir):
    history = cr.message_history(turns(spark, sf_dir))
    return history.withColumn("messages", F.to_json("messages"))


def _payload(spark, sf_dir, build, part_turns):
    args = (F.col("history"), F.col("prompt"), F.col("system_message"))
    bounds = {"first": F.col("part_no") == 0, "last": F.col("is_last")}
    rows = requests(spark, sf_dir, part_turns)
    return rows.select(
        "conv_id", "part_no", "n_parts", build(*args, max_tokens=MAX_TOKENS, **bounds).alias("payload"))


def _claude(*args, max_tokens, **bounds):
    return cr.payload_claude(F.lit("claude-3-haiku-20240307"), *args, **bounds)


_payload_query(
    "ch2_payload_openai", lambda *a, **k: cr.payload_openai(F.col("model"), *a, **k),
    f"""'{{"model":"' || model || '","messages":' || {LED} || ',"stream":false' || {OPENAI_TAIL} || '}}'""")
_payload_query(
    "ch3_payload_grok", lambda *a, **k: cr.payload_grok(F.lit("grok-3"), *a, **k),
    f"""'{{"model":"grok-3","messages":' || {LED} || ',"temperature":0.7,"stream":false,"max_tokens":256}}'""")
_payload_query(
    "ch4_payload_claude", _claude,
    f"""'{{"model":"claude-3-haiku-20240307","messages":' || {PLAIN}
    || ',"max_tokens":8096,"temperature":0.7' || {SYSTEM_TAIL} || '}}'""")
_payload_query("ch5_payload_gemini", cr.payload_gemini, GEMINI_CONTENTS + " || '}'")


@query("ch6_payload_tools", i.with_views(f"""
SELECT conv_id, CAST(0 AS BIGINT) AS part_no, CAST(1 AS BIGINT) AS n_parts,
  '{{"model":"' || model || '","messages":' || {LED} || ',"tools":{TOOLS_JSON},"tool_choice":"auto"' || {OPENAI_TAIL} || '}}' AS openai,
  '{{"model":"grok-3","messages":' || {LED} || ',"tools":{TOOLS_JSON},"tool_choice":"auto","temperature":0.7,"max_tokens":256}}' AS grok,
  '{{"model":"claude-3-haiku-20240307","messages":' || {PLAIN} || ',"tools":{TOOLS_JSON},"max_tokens":256,"temperature":0.7' || {SYSTEM_TAIL} || '}}' AS claude,
  {GEMINI_CONTENTS} || ',"tools":{GEMINI_TOOLS_JSON}}}' AS gemini
FROM requests""", requests=REQUESTS))
def ch6(spark, sf_dir):
    args = (F.col("history"), F.col("prompt"), F.col("system_message"))
    common = {"max_tokens": MAX_TOKENS, "tools": F.lit(TOOLS_JSON),
              "first": F.col("part_no") == 0, "last": F.col("is_last")}
    return requests(spark, sf_dir).select(
        "conv_id", "part_no", "n_parts",
        cr.payload_openai(F.col("model"), *args, **common).alias("openai"),
        cr.payload_grok(F.lit("grok-3"), *args, **common).alias("grok"),
        cr.payload_claude(F.lit("claude-3-haiku-20240307"), *args, **common).alias("claude"),
        cr.payload_gemini(*args, **common).alias("gemini"),
    )


# --- CH7, CH8: images made of a header and a whole page --------------------------

IMAGE_HEADS = "['FFD8FFE0', '89504E470D0A1A0A', '474946383961', '524946460000000057454250', '00']"
PICTURES = f"""
SELECT page_id, page_id % 6 AS kind, url,
  CASE WHEN page_id % 6 = 5 THEN 'data:image/webp;base64,' ELSE '' END AS prefix,
  to_base64(from_hex({IMAGE_HEADS}[1 + CAST(least(page_id % 6, 4) AS BIGINT)]) || encode(html)) AS data
FROM pages
"""
KIND = "CASE kind WHEN 0 THEN 'jpeg' WHEN 2 THEN 'gif' WHEN 3 THEN 'webp' WHEN 5 THEN 'webp' ELSE 'png' END"


def pictures(spark, sf_dir):
    heads = F.array(*[F.lit(h) for h in json.loads(IMAGE_HEADS.replace("'", '"'))])
    head = F.get(heads, F.least(F.col("page_id") % 6, F.lit(4)).cast("int"))
    encoded = F.base64(F.concat(F.unhex(head), F.encode("html", "UTF-8")))
    data = F.translate(encoded, "\r\n", "")
    prefix = F.when(F.col("page_id") % 6 == 5, "data:image/webp;base64,").otherwise("")
    return i.table(spark, sf_dir, "pages").select("page_id", "url", F.concat(prefix, data).alias("image"))


@query("ch7_image_format", i.with_views(f"""
SELECT page_id, 'image/' || {KIND} AS mime, {KIND} AS extension FROM pictures""", pictures=PICTURES))
def ch7(spark, sf_dir):
    image = F.col("image")
    return pictures(spark, sf_dir).select(
        "page_id", im.image_mime(image).alias("mime"), im.image_extension(image).alias("extension"))


@query("ch8_image_content", i.with_views(f"""
SELECT page_id,
  '[{{"type":"text","text":' || {_text('url')} || '}},{{"type":"image_url","image_url":{{"url":"data:image/' || {KIND} || ';base64,' || data || '"}}}}]' AS openai,
  '[{{"type":"image","source":{{"type":"base64","media_type":"image/' || {KIND} || '","data":"' || data || '"}}}},{{"type":"text","text":' || {_text('url')} || '}}]' AS claude,
  '[{{"text":' || {_text('url')} || '}},{{"inline_data":{{"mime_type":"image/' || {KIND} || '","data":"' || data || '"}}}}]' AS gemini
FROM pictures""", pictures=PICTURES))
def ch8(spark, sf_dir):
    prompt, images = F.col("url"), F.array("image")
    return pictures(spark, sf_dir).select(
        "page_id", im.content_openai(prompt, images).alias("openai"),
        im.content_claude(prompt, images).alias("claude"),
        im.content_gemini(prompt, images).alias("gemini"))


# --- CH9, CH10: response bodies ---------------------------------------------------

NUMBERED = """
SELECT conv_id * 1000 + turn AS request_id, text,
  CASE (conv_id + turn) % 4 WHEN 0 THEN 'openai' WHEN 1 THEN 'grok' WHEN 2 THEN 'claude' ELSE 'gemini' END AS provider
FROM conversations
"""


def numbered(spark, sf_dir):
    return i.view(spark, sf_dir, NUMBERED)


def _by_provider(**bodies):
    provider = F.col("provider")
    return (
        F.when(provider.isin(rs.OPENAI_LIKE), bodies["openai"])
        .when(provider == "claude", bodies["claude"]).otherwise(bodies["gemini"])
    )


def text_bodies(spark, sf_dir):
    text = as_json(F.col("text"))
    body = _by_provider(
        openai=F.concat(F.lit('{"choices":[{"message":{"content":'), text, F.lit("}}]}")),
        claude=F.concat(F.lit('{"content":[{"type":"text","text":'), text, F.lit("}]}")),
        gemini=F.concat(
            F.lit('{"candidates":[{"content":{"parts":[{"text":'), text,
            F.lit('},{"inlineData":{}},{"text":" end"}]}}]}')),
    )
    failing = F.when(F.col("request_id") % 7 == 0, '{"error":{"code":500}}').when(
        F.col("request_id") % 11 == 0, "{}")
    return numbered(spark, sf_dir).withColumn("body", F.coalesce(failing, body))


@query("ch9_response_text", i.with_views("""
SELECT request_id, provider,
  CASE WHEN request_id % 7 <> 0 AND request_id % 11 <> 0
    THEN text || CASE WHEN provider = 'gemini' THEN ' end' ELSE '' END END AS text,
  CASE WHEN request_id % 7 = 0 AND provider <> 'claude' THEN 'Error: {"code":500}'
       WHEN request_id % 7 = 0 OR request_id % 11 = 0 THEN
         CASE WHEN provider IN ('openai', 'grok') THEN 'Error parsing response' ELSE 'No content in response' END
  END AS error FROM numbered""", numbered=NUMBERED))
def ch9(spark, sf_dir):
    return rs.response_text(text_bodies(spark, sf_dir))


ARGUMENTS_SQL = """'{"request":' || request_id || ',"text":' || CAST(to_json(text) AS VARCHAR) || '}'"""


def _arguments():
    return json_object({
        "request": F.col("request_id").cast("string"), "text": as_json(F.col("text"))})


def call_bodies(spark, sf_dir):
    """Two calls per body: one with the whole text, one without arguments."""
    args = _arguments()
    body = _by_provider(
        openai=F.concat(
            F.lit('{"choices":[{"message":{"content":null,"tool_calls":['
                  '{"id":"a","function":{"name":"keep","arguments":'), as_json(args),
            F.lit('}},{"id":"b","function":{"name":"stop","arguments":"{}"}}]}}]}')),
        claude=F.concat(
            F.lit('{"content":[{"type":"text","text":"on it"},'
                  '{"type":"tool_use","id":"a","name":"keep","input":'), args,
            F.lit('},{"type":"tool_use","id":"b","name":"stop","input":{}}]}')),
        gemini=F.concat(
            F.lit('{"candidates":[{"content":{"parts":[{"functionCall":{"name":"keep","args":'), args,
            F.lit('}},{"text":"on it"},{"functionCall":{"name":"stop"}}]}}]}')),
    )
    failing = F.when(F.col("request_id") % 7 == 0, '{"error":{"code":500}}').when(
        F.col("request_id") % 11 == 0, "{broken")
    return numbered(spark, sf_dir).withColumn("body", F.coalesce(failing, body))


@query("ch10_response_tool_calls", i.with_views(f"""
SELECT request_id, provider, 0 AS call_no, CASE WHEN provider = 'gemini' THEN 'keep' ELSE 'a' END AS id,
  'keep' AS name, {ARGUMENTS_SQL} AS arguments, NULL AS error FROM numbered WHERE request_id % 7 <> 0 AND request_id % 11 <> 0
UNION ALL SELECT request_id, provider, 1, CASE WHEN provider = 'gemini' THEN 'stop' ELSE 'b' END,
  'stop', '{{}}', NULL FROM numbered WHERE request_id % 7 <> 0 AND request_id % 11 <> 0
UNION ALL SELECT request_id, provider, NULL, NULL, NULL, NULL,
  CASE WHEN request_id % 7 = 0 THEN 'Error: {{"code":500}}' ELSE 'Error parsing response' END
FROM numbered WHERE request_id % 7 = 0 OR request_id % 11 = 0""", numbered=NUMBERED))
def ch10(spark, sf_dir):
    return rs.response_tool_calls(call_bodies(spark, sf_dir))


# --- CH11-CH16: recorded streams ---------------------------------------------------

CHUNK = "(?s).{1,40}"


def _chunks(spark, sf_dir, text):
    """Whole texts cut into pieces of 40 characters, numbered from 1."""
    pieces = F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))
    return numbered(spark, sf_dir).select("request_id", F.posexplode(pieces).alias("n", "piece"))


def _lines(spark, sf_dir, chunks, line, before=(), after=()):
    """Stream lines: fixed lines before, one per chunk, fixed lines after."""
    rows = chunks.select("request_id", (F.col("n") + 100).cast("bigint").alias("line_no"), line.alias("line"))
    fixed = [*enumerate(before), *enumerate(after, 100_000)]
    cells = F.array(*[F.struct(F.lit(n).cast("bigint").alias("line_no"), F.lit(x).alias("line")) for n, x in fixed])
    return rows.union(numbered(spark, sf_dir).select("request_id", F.inline(cells)))


def _delta(members):
    return F.concat(F.lit('data: {"choices":[{"delta":'), members, F.lit("}]}"))


TEXT_SQL = i.with_views(
    "SELECT request_id, CAST(0 AS BIGINT) AS part_no, CAST(1 AS BIGINT) AS n_parts, text FROM numbered", numbered=NUMBERED)


@query("ch11_stream_text_delta", TEXT_SQL)
def ch11(spark, sf_dir):
    line = _delta(json_object({"content": as_json(F.col("piece"))}))
    lines = _lines(
        spark, sf_dir, _chunks(spark, sf_dir, F.col("text")), line,
        before=["", ": comment", 'data: {"choices":[{"delta":{"role":"assistant"}}]}', "data: {broken"],
        after=["data: [DONE]", 'data: {"choices":[{"delta":{"content":"late"}}]}'])
    return st.stream_text_delta(lines)


@query("ch12_stream_text_blocks", TEXT_SQL)
def ch12(spark, sf_dir):
    line = F.concat(
        F.lit('data: {"type":"content_block_delta","delta":{"type":"text_delta","text":'),
        as_json(F.col("piece")), F.lit("}}"))
    lines = _lines(
        spark, sf_dir, _chunks(spark, sf_dir, F.col("text")), line,
        before=["event: message_start", 'data: {"type":"content_block_start","index":0}'],
        after=['data: {"type":"message_stop"}',
               'data: {"type":"content_block_delta","delta":{"text":"late"}}'])
    return st.stream_text_blocks(lines)


@query("ch13_stream_text_jsonl", TEXT_SQL)
def ch13(spark, sf_dir):
    line = F.concat(
        F.lit('{"candidates":[{"content":{"parts":[{"text":'), as_json(F.col("piece")),
        F.lit('},{"functionCall":{"name":"keep"}}]}}]}'))
    lines = _lines(
        spark, sf_dir, _chunks(spark, sf_dir, F.col("text")), line,
        before=["[broken", '{"candidates":[]}'])
    return st.stream_text_jsonl(lines)


#: Lines to a part in the second registration of a query.
FEW_LINES = 4


def _twice(name, sql, lines, build):
    """`build` on the lines, and again in parts of FEW_LINES: the same calls."""
    @query(name, sql)
    def whole(spark, sf_dir):
        return build(lines(spark, sf_dir), st.PART_LINES)

    @query(f"{name}_parts", sql)
    def parts(spark, sf_dir):
        return build(lines(spark, sf_dir), FEW_LINES)


CH14_SQL = i.with_views(f"""
SELECT request_id, 0 AS call_index, 'a' AS id, 'keep' AS name,
  {ARGUMENTS_SQL} AS arguments FROM numbered
UNION ALL SELECT request_id, 2, 'b2', 'stop', '{{}}' FROM numbered""", numbered=NUMBERED)


def _delta_lines(spark, sf_dir):
    call = json_object({"arguments": as_json(F.col("piece"))})
    line = _delta(F.concat(
        F.lit('{"tool_calls":[{"index":0,"id":"","function":'), call, F.lit("}]}")))
    return _lines(
        spark, sf_dir, _chunks(spark, sf_dir, _arguments()), line,
        before=['data: {"choices":[{"delta":{"tool_calls":[{"id":"a","function":{"name":"keep"}},'
                '{"index":2,"id":"b","function":{"name":"stop","arguments":"{not"}}]}}]}',
                'data: {"choices":[{"delta":{"tool_calls":[{"index":2,"id":"b2"}]}}]}'],
        after=["data: [DONE]",
               'data: {"choices":[{"delta":{"tool_calls":[{"index":0,"id":"late"}]}}]}'])


_twice("ch14_stream_tool_calls_delta", CH14_SQL, _delta_lines, st.stream_tool_calls_delta)

CH15_SQL = i.with_views(f"""
SELECT request_id, CAST(1 AS BIGINT) AS block_index, 'a' AS id, 'keep' AS name, '{{}}' AS arguments FROM numbered
UNION ALL SELECT request_id, 2, 'b', 'stop', {ARGUMENTS_SQL} FROM numbered""", numbered=NUMBERED)


def _block_lines(spark, sf_dir):
    # Lines name block 1 but block 2 was started last, so block 2 gets the text. Block 2
    # was open before, under another name; block 7 never is.
    line = F.concat(
        F.lit('data: {"type":"content_block_delta","index":1,"delta":{"type":"input_json_delta","partial_json":'),
        as_json(F.col("piece")), F.lit("}}"))
    stray = 'data: {"type":"content_block_delta","delta":{"type":"input_json_delta","partial_json":"stray"}}'
    return _lines(
        spark, sf_dir, _chunks(spark, sf_dir, _arguments()), line,
        before=[stray, 'data: {"type":"content_block_start","index":7,"content_block":{"type":"text"}}', stray,
                'data: {"type":"content_block_start","index":2,"content_block":{"type":"tool_use","id":"old","name":"old"}}',
                stray, 'data: {"type":"content_block_start","index":0,"content_block":{"type":"text"}}',
                'data: {"type":"content_block_start","index":1,"content_block":{"type":"tool_use","id":"a","name":"keep"}}',
                'data: {"type":"content_block_start","index":2,"content_block":{"type":"tool_use","id":"b","name":"stop"}}'],
        after=['data: {"type":"message_stop"}',
               'data: {"type":"content_block_delta","delta":{"type":"input_json_delta","partial_json":"late"}}'])


_twice("ch15_stream_tool_calls_blocks", CH15_SQL, _block_lines, st.stream_tool_calls_blocks)


@query("ch16_stream_tool_calls_merge", i.with_views("""
SELECT request_id, CAST(0 AS BIGINT) AS first_line, 'stop' AS id, 'stop' AS name,
  '{}' AS arguments FROM numbered
UNION ALL
SELECT request_id, 1, 'keep', 'keep', '{"first":true,"last":'
  || CAST(to_json(right(text, CAST((length(text) - 1) % 40 + 1 AS BIGINT))) AS VARCHAR)
  || ',"n":' || ((length(text) + 39) // 40) || '}' FROM numbered""", numbered=NUMBERED))
def ch16(spark, sf_dir):
    call = json_object({
        "last": as_json(F.col("piece")), "n": (F.col("n") + 1).cast("string")})
    line = F.concat(
        F.lit('{"candidates":[{"content":{"parts":[{"text":"on it"},{"functionCall":{"name":"keep","args":'),
        call, F.lit("}}]}}]}"))
    lines = _lines(
        spark, sf_dir, _chunks(spark, sf_dir, F.col("text")), line,
        before=['{"candidates":[{"content":{"parts":[{"functionCall":{"name":"stop"}}]}}]}',
                '{"candidates":[{"content":{"parts":[{"functionCall":{"name":"keep","args":{"first":true}}}]}}]}'])
    return st.stream_tool_calls_merge(lines)
