"""Recorded response bodies: reply text and tool calls (CH9, CH10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from postlake.functions.compose import derive

OPENAI_LIKE = ["openai", "grok"]


def _get(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


def _text_parts(parts: Column) -> Column:
    return F.filter(parts, lambda p: _get(p, "$.text", "variant").isNotNull())


def _joined_text(parts: Column) -> Column:
    texts = F.transform(_text_parts(parts), lambda p: F.coalesce(_get(p, "$.text", "string"), F.lit("")))
    return F.array_join(texts, "")


def _claude_blocks(body: Column, kind: str) -> Column:
    blocks = _get(body, "$.content", "array<variant>")
    return F.filter(blocks, lambda b: _get(b, "$.type", "string") == kind)


def _gemini_parts(body: Column) -> Column:
    return _get(body, "$.candidates[0].content.parts", "array<variant>")


def response_text(bodies: DataFrame, all_blocks: bool = False) -> DataFrame:
    """CH9: (request_id, provider, text, error) from `body` JSON.

    An error member gives an error. The claude provider's first block is the
    reply, or with `all_blocks`, as in calls with tools, all its text blocks.
    """
    parsed = derive(bodies, ["request_id", "provider"], body=F.try_parse_json("body"))
    body, provider = F.col("body"), F.col("provider")
    failure = _get(body, "$.error", "variant")
    if all_blocks:
        claude = _joined_text(_claude_blocks(body, "text"))
    else:
        claude = _get(body, "$.content[0].text", "string")
    text = (
        F.when(provider.isin(OPENAI_LIKE), _get(body, "$.choices[0].message.content", "string"))
        .when(provider == "claude", claude)
        .otherwise(_joined_text(_gemini_parts(body)))
    )
    found = (
        F.when(
            provider.isin(OPENAI_LIKE),
            _get(body, "$.choices[0].message.content", "variant").isNotNull(),
        )
        .when(provider == "claude", claude.isNotNull())
        .otherwise(_gemini_parts(body).isNotNull())
    )
    lost = F.when(provider.isin(OPENAI_LIKE), "Error parsing response").otherwise(
        "No content in response"
    )
    has_failed = failure.isNotNull() & (provider != "claude")
    error = (
        F.when(body.isNull(), "Error parsing response")
        .when(has_failed, F.concat(F.lit("Error: "), F.to_json(failure)))
        .when(~F.coalesce(found, F.lit(False)), lost)
    )
    return parsed.select(
        "request_id", "provider", F.when(error.isNull(), text).alias("text"), error.alias("error")
    )


def response_tool_calls(bodies: DataFrame) -> DataFrame:
    """CH10: one row per tool call: (request_id, provider, call_no, id, name, arguments, error).

    Arguments are JSON text. Where they are malformed they are NULL and `error` says so. A
    body that failed or cannot be read gives one row with the error and no call; a body
    without calls gives no row. Some providers send arguments as a JSON string, one sends
    no call ids and its calls take the function name.
    """
    parsed = derive(bodies, ["request_id", "provider"], body=F.try_parse_json("body"))
    body, provider = F.col("body"), F.col("provider")

    def call(id_: Column, name: Column, arguments: Column) -> Column:
        return F.struct(id_.alias("id"), name.alias("name"), arguments.alias("arguments"))

    openai = F.transform(
        _get(body, "$.choices[0].message.tool_calls", "array<variant>"),
        lambda t: call(
            _get(t, "$.id", "string"),
            _get(t, "$.function.name", "string"),
            F.to_json(F.try_parse_json(_get(t, "$.function.arguments", "string"))),
        ),
    )
    claude = F.transform(
        _claude_blocks(body, "tool_use"),
        lambda b: call(
            _get(b, "$.id", "string"), _get(b, "$.name", "string"),
            F.to_json(_get(b, "$.input", "variant")),
        ),
    )
    called = F.filter(
        _gemini_parts(body),
        lambda p: _get(p, "$.text", "variant").isNull()
        & _get(p, "$.functionCall", "variant").isNotNull(),
    )
    gemini = F.transform(
        called,
        lambda p: call(
            _get(p, "$.functionCall.name", "string"), _get(p, "$.functionCall.name", "string"),
            F.coalesce(F.to_json(_get(p, "$.functionCall.args", "variant")), F.lit("{}")),
        ),
    )
    calls = F.when(provider.isin(OPENAI_LIKE), openai).when(provider == "claude", claude).otherwise(gemini)
    failure = _get(body, "$.error", "variant")
    error = F.when(body.isNull(), "Error parsing response").when(
        failure.isNotNull(), F.concat(F.lit("Error: "), F.to_json(failure)))
    found = parsed.select("request_id", "provider", error.alias("failed"), calls.alias("calls"))
    listed = F.when(F.col("failed").isNull(), F.col("calls"))
    rows = found.select("request_id", "provider", "failed", F.posexplode_outer(listed).alias("call_no", "call"))
    malformed = F.when(F.col("call").isNotNull() & F.col("call.arguments").isNull(), "Malformed arguments")
    return rows.filter(F.col("failed").isNotNull() | F.col("call").isNotNull()).select(
        "request_id", "provider", "call_no", "call.id", "call.name", "call.arguments",
        F.coalesce("failed", malformed).alias("error"),
    )
