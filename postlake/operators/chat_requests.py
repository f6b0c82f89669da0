"""Chat requests as tables: message history and provider payloads (CH1-CH6).

A conversation may be arbitrarily long, so turns are grouped per conversation and
per PART_TURNS positions in it, and every result is a row per part: `part_no` from 0
to `n_parts` - 1, counting the parts that exist. A usual conversation is one part, and
its payload one complete JSON text; the payloads of several parts, in order,
concatenate to it. No task holds more than one part.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from postlake.functions.images import content_claude, content_gemini, content_openai
from postlake.functions.jsontext import as_json, fields, json_object, not_empty
from postlake.lists import (
    CLAUDE_DEFAULT_MAX_TOKENS,
    COMPLETION_TOKEN_MODELS,
    DEFAULT_TEMPERATURE,
)

PART_TURNS = 1 << 12


def _numbered_messages(turns: DataFrame, part_turns: int) -> DataFrame:
    slot = F.floor(F.col("turn") / part_turns)
    message = F.struct("turn", "role", F.col("text").alias("content"))
    return turns.groupBy("conv_id", slot.alias("slot")).agg(
        F.array_sort(F.collect_list(message)).alias("numbered")
    )


def _messages(numbered: Column) -> Column:
    return F.transform(
        numbered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))
    )


def _parts(turns: DataFrame, part_turns: int) -> DataFrame:
    """One thin row per part that exists: slot, part_no, n_parts, is_last and the system turn."""
    slot = F.floor(F.col("turn") / part_turns).alias("slot")
    system = F.when(F.col("role") == "system", F.struct("turn", "text"))
    conversation = W.partitionBy("conv_id")
    nth = (F.row_number().over(conversation.orderBy("slot")) - 1).cast("bigint")
    count = F.count(F.lit(1)).over(conversation)
    return turns.groupBy("conv_id", slot).agg(F.min(system).alias("system_turn")).select(
        "conv_id", "slot", nth.alias("part_no"), count.alias("n_parts"), (nth == count - 1).alias("is_last"),
        F.min("system_turn").over(conversation).alias("system_turn"),
    )


def message_history(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """CH1: (conv_id, part_no, n_parts, messages), messages in order of turn."""
    parts = _parts(turns, part_turns).select("conv_id", "slot", "part_no", "n_parts")
    return parts.join(_numbered_messages(turns, part_turns), ["conv_id", "slot"]).select(
        "conv_id", "part_no", "n_parts", _messages(F.col("numbered")).alias("messages")
    )


def chat_requests(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """One request per conversation: the last turn is the prompt, the rest history.

    The first system turn, if any, is also the system message. Of rows that share the last
    turn number, the last by role and text is the prompt. Conversation facts, free of
    any other text, are repeated for each part and joined on (conv_id, slot), the key
    the parts are grouped by: a long conversation spreads over many tasks.
    """
    is_last = F.col("is_last")
    # Only the outer parts of a payload need the system message.
    slots = _parts(turns, part_turns).select(
        "conv_id", "slot", "part_no", "n_parts", "is_last",
        F.when(is_last | (F.col("part_no") == 0), F.col("system_turn.text")).alias("system_message"),
    )
    joined = slots.join(_numbered_messages(turns, part_turns), ["conv_id", "slot"])
    numbered = F.col("numbered")
    earlier = F.when(is_last, F.slice(numbered, 1, F.size(numbered) - 1)).otherwise(numbered)
    return joined.select(
        "conv_id", "part_no", "n_parts", "is_last", _messages(earlier).alias("history"),
        "system_message", F.when(is_last, F.element_at(numbered, -1)["content"]).alias("prompt"),
    )


def _number(value: Any) -> Column | None:
    if value is None:
        return None
    return value.cast("string") if isinstance(value, Column) else as_json(value)


def _compose(
    before: dict[str, Column], list_name: str, lead: Column | None, history: Column,
    user: Column, after: dict[str, Column], first: Column | None, last: Column | None,
) -> Column:
    """One part of `{before, "list_name": [lead, history, user], after}`.

    Without `first` and `last` the row is the whole request.
    """
    first = F.lit(True) if first is None else first
    last = F.lit(True) if last is None else last
    head = F.concat(F.lit("{"), F.concat_ws(
        ",", not_empty(fields(before)) if before else F.lit(None).cast("string"),
        F.lit(f'"{list_name}":['),
    ))
    tail = F.concat(F.concat_ws(",", F.lit("]"), not_empty(fields(after))), F.lit("}"))
    listed = F.array_join(history, ",")
    items = F.concat_ws(
        ",",
        F.when(first, lead) if lead is not None else F.lit(None).cast("string"),
        not_empty(listed),
        F.when(last, user),
    )
    return F.concat(
        F.when(first, head).otherwise(""), items,
        F.when(~last & (items != ""), ",").otherwise(""),
        F.when(last, tail).otherwise(""),
    )


def _plain_history(history: Column) -> Column:
    return F.transform(F.coalesce(history, F.array()), lambda m: F.to_json(m))


def _user_message(prompt: Column, images: Column | None, with_images: Any) -> Column:
    text = F.coalesce(as_json(prompt), F.lit("null"))
    content = text if images is None else F.when(
        F.size(F.coalesce(images, F.array())) > 0, with_images(prompt, images)
    ).otherwise(text)
    return json_object({"role": as_json("user"), "content": content})


def _system(system: Column | None) -> Column:
    return F.lit(None).cast("string") if system is None else not_empty(system)


def _present(members: dict[str, Column | None]) -> dict[str, Column]:
    return {k: v for k, v in members.items() if v is not None}


def _tool_members(tools: Column | None) -> dict[str, Column | None]:
    return {"tools": tools, "tool_choice": None if tools is None else as_json("auto")}


def _stream_member(tools: Column | None, stream: bool, always: bool) -> Column | None:
    return as_json(stream) if stream or (always and tools is None) else None


def payload_openai(
    model: Column, history: Column, prompt: Column, system: Column | None = None,
    temperature: Any = DEFAULT_TEMPERATURE, max_tokens: Any = None,
    images: Column | None = None, tools: Column | None = None, stream: bool = False,
    first: Column | None = None, last: Column | None = None,
) -> Column:
    """CH2: system, history and user messages; some models fix their temperature
    and count completion tokens."""
    system = _system(system)
    lead = F.when(system.isNotNull(), json_object(
        {"role": as_json("system"), "content": as_json(system)}
    ))
    fixed = model.isin(COMPLETION_TOKEN_MODELS)
    tokens = _number(max_tokens)
    after = _present({
        **_tool_members(tools),
        "stream": _stream_member(tools, stream, always=True),
        "temperature": F.when(~fixed, _number(temperature)),
        "max_completion_tokens": None if tokens is None else F.when(fixed, tokens),
        "max_tokens": None if tokens is None else F.when(~fixed, tokens),
    })
    return _compose(
        {"model": as_json(model)}, "messages", lead, _plain_history(history),
        _user_message(prompt, images, content_openai), after, first, last,
    )


def payload_grok(
    model: Column, history: Column, prompt: Column, system: Column | None = None,
    temperature: Any = DEFAULT_TEMPERATURE, max_tokens: Any = None,
    images: Column | None = None, tools: Column | None = None, stream: bool = False,
    first: Column | None = None, last: Column | None = None,
) -> Column:
    """CH3: as CH2 with temperature and max_tokens for every model."""
    system = _system(system)
    lead = F.when(system.isNotNull(), json_object(
        {"role": as_json("system"), "content": as_json(system)}
    ))
    after = _present({
        **_tool_members(tools),
        "temperature": _number(temperature),
        "stream": _stream_member(tools, stream, always=True),
        "max_tokens": _number(max_tokens),
    })
    return _compose(
        {"model": as_json(model)}, "messages", lead, _plain_history(history),
        _user_message(prompt, images, content_openai), after, first, last,
    )


def payload_claude(
    model: Column, history: Column, prompt: Column, system: Column | None = None,
    temperature: Any = DEFAULT_TEMPERATURE, max_tokens: Any = None,
    images: Column | None = None, tools: Column | None = None, stream: bool = False,
    first: Column | None = None, last: Column | None = None,
) -> Column:
    """CH4: the system message at top level; max_tokens always present."""
    default = F.lit(str(CLAUDE_DEFAULT_MAX_TOKENS))
    tokens = _number(max_tokens)
    tokens = default if tokens is None else F.coalesce(F.nullif(tokens, F.lit("0")), default)
    after = _present({
        "tools": tools,
        "max_tokens": tokens,
        "temperature": _number(temperature),
        "stream": _stream_member(tools, stream, always=False),
        "system": as_json(_system(system)),
    })
    return _compose(
        {"model": as_json(model)}, "messages", None, _plain_history(history),
        _user_message(prompt, images, content_claude), after, first, last,
    )


def payload_gemini(
    history: Column, prompt: Column, system: Column | None = None,
    temperature: Any = DEFAULT_TEMPERATURE, max_tokens: Any = None,
    images: Column | None = None, tools: Column | None = None,
    first: Column | None = None, last: Column | None = None,
) -> Column:
    """CH5: contents of parts. Only user and assistant turns of the history are
    sent, the latter as `model`; a turn without a role is the user's. The model name
    is part of the address."""
    def speaker(message: Column) -> Column:
        return F.coalesce(message["role"], F.lit("user"))

    spoken = F.filter(
        F.coalesce(history, F.array()), lambda m: speaker(m).isin("user", "assistant")
    )

    def text_part(text: Column) -> Column:
        return F.concat(F.lit('[{"text":'), F.coalesce(as_json(text), F.lit("null")), F.lit("}]"))

    def content(message: Column) -> Column:
        role = F.when(speaker(message) == "assistant", as_json("model")).otherwise(as_json("user"))
        said = F.coalesce(message["content"], F.lit(""))
        return json_object({"role": role, "parts": text_part(said)})

    user_parts = text_part(prompt) if images is None else F.when(
        F.size(F.coalesce(images, F.array())) > 0, content_gemini(prompt, images)
    ).otherwise(text_part(prompt))
    system = _system(system)
    after = _present({
        "generationConfig": json_object(_present({
            "temperature": _number(temperature), "maxOutputTokens": _number(max_tokens),
        })),
        "systemInstruction": F.when(
            system.isNotNull(), json_object({"parts": text_part(system)})
        ),
        "tools": None if tools is None else gemini_tools(tools),
    })
    return _compose(
        {}, "contents", None, F.transform(spoken, content),
        json_object({"role": as_json("user"), "parts": user_parts}), after, first, last,
    )


def gemini_tools(tools: Column) -> Column:
    """CH6: tool definitions as one list of function declarations, NULL without any."""
    listed = F.from_json(
        tools,
        "array<struct<function:struct<name:string,description:string,parameters:string>>>",
    )
    functions = F.filter(listed, lambda t: t["function"].isNotNull())

    def declaration(tool: Column) -> Column:
        f = tool["function"]
        return json_object({
            "name": as_json(f["name"]), "description": as_json(f["description"]),
            "parameters": f["parameters"],
        })

    declared = F.array_join(F.transform(functions, declaration), ",")
    return F.when(
        F.size(functions) > 0,
        F.concat(F.lit('[{"functionDeclarations":['), declared, F.lit("]}]")),
    )
