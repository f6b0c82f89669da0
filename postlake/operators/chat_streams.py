"""Recorded stream lines put together again (CH11-CH16).

Input is a table (request_id, line_no, line). One request may hold a large share
of all lines, so lines are grouped per request and per PART_LINES positions in it.
Texts come back as rows in order of `part_no`, of which there are `n_parts` (one for a usual
reply); their concatenation is the whole. Tool calls are put together from their
pieces in every part and come back whole, one row per call, whatever the parts.
Where a step depends on earlier lines (a stop line, the block last started), that
fact is found per part first, in a table with one thin row per part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from postlake.functions.compose import derive
from postlake.functions.jsontext import as_json

PART_LINES = 1 << 17
DATA = "data: "
KEY = ["request_id", "part_no"]


def _payload(line: Column) -> Column:
    return F.when(F.startswith(line, F.lit(DATA)), F.substring(line, F.lit(len(DATA) + 1), F.length(line)))


def _is_done(line: Column) -> Column:
    return F.trim(_payload(line)) == "[DONE]"


def _is_message_stop(line: Column) -> Column:
    data = F.when(F.contains(line, F.lit("message_stop")), F.try_parse_json(_payload(line)))
    return F.try_variant_get(data, "$.type", "string") == "message_stop"


def _with_part(lines: DataFrame, part_lines: int) -> DataFrame:
    return lines.withColumn("part_no", F.floor(F.col("line_no") / part_lines))


def _facts(lines: DataFrame, stop: Column, started: Column | None = None) -> DataFrame:
    """One row per part up to the stop line: stop_at, block carried in, and the part's
    place among the `n_parts` that exist.

    The window runs over parts, not lines: a billion lines are a few thousand rows.
    """
    started = F.lit(None).cast("bigint") if started is None else started
    facts = lines.groupBy(*KEY).agg(
        F.min(F.when(stop, F.col("line_no"))).alias("stop_here"),
        F.max_by(started, F.when(started.isNotNull(), F.col("line_no"))).alias("started_here"),
    )
    request = W.partitionBy("request_id")
    earlier = request.orderBy("part_no").rowsBetween(W.unboundedPreceding, -1)
    kept = facts.select(
        *KEY,
        F.min("stop_here").over(request).alias("stop_at"),
        F.min("stop_here").over(earlier).alias("stopped_before"),
        F.last("started_here", ignorenulls=True).over(earlier).alias("carried"),
    ).filter(F.col("stopped_before").isNull()).drop("stopped_before")
    return kept.withColumns({
        "nth": (F.row_number().over(request.orderBy("part_no")) - 1).cast("bigint"),
        "n_parts": F.count(F.lit(1)).over(request),
    })


def _kept() -> Column:
    return F.coalesce(F.col("line_no") < F.col("stop_at"), F.lit(True))


def _ordered_text(piece: Column, *order: str) -> Column:
    numbered = F.when(F.coalesce(piece, F.lit("")) != "", F.struct(*order, piece.alias("piece")))
    listed = F.array_sort(F.collect_list(numbered))
    return F.array_join(F.transform(listed, lambda x: x["piece"]), "")


def _texts(lines: DataFrame, piece: Column, stop: Column, part_lines: int) -> DataFrame:
    numbered = _with_part(lines, part_lines)
    facts = _facts(numbered, stop).select(*KEY, "stop_at", "nth", "n_parts")
    pieces = derive(
        numbered.join(facts, KEY), [*KEY, "line_no", "nth", "n_parts"], piece=F.when(_kept(), piece))
    return pieces.groupBy(*KEY, "nth", "n_parts").agg(
        _ordered_text(F.col("piece"), "line_no").alias("text")
    ).select("request_id", F.col("nth").alias("part_no"), "n_parts", "text")


def stream_text_delta(lines: DataFrame, part_lines: int = PART_LINES) -> DataFrame:
    """CH11: text of `data:` lines with choice deltas, up to `[DONE]`."""
    data = F.try_parse_json(_payload(F.col("line")))
    piece = F.try_variant_get(data, "$.choices[0].delta.content", "string")
    return _texts(lines, piece, _is_done(F.col("line")), part_lines)


def stream_text_blocks(lines: DataFrame, part_lines: int = PART_LINES) -> DataFrame:
    """CH12: text of content block deltas, up to `message_stop`."""
    data = F.try_parse_json(_payload(F.col("line")))
    piece = F.when(
        F.try_variant_get(data, "$.type", "string") == "content_block_delta",
        F.try_variant_get(data, "$.delta.text", "string"),
    )
    return _texts(lines, piece, _is_message_stop(F.col("line")), part_lines)


def stream_text_jsonl(lines: DataFrame, part_lines: int = PART_LINES) -> DataFrame:
    """CH13: text parts of one JSON object per line; there is no stop line."""
    parts = F.try_variant_get(
        F.try_parse_json("line"), "$.candidates[0].content.parts", "array<variant>"
    )
    texts = F.transform(parts, lambda p: F.try_variant_get(p, "$.text", "string"))
    return _texts(lines, F.array_join(texts, ""), F.lit(False), part_lines)


def _checked(arguments: Column) -> Column:
    """JSON text of the arguments, `{}` if they are empty or malformed."""
    return F.coalesce(F.to_json(F.try_parse_json(F.nullif(arguments, F.lit("")))), F.lit("{}"))


def stream_tool_calls_delta(lines: DataFrame, part_lines: int = PART_LINES) -> DataFrame:
    """CH14: tool calls by call index: last non-empty id and name, arguments joined."""
    numbered = _with_part(lines, part_lines)
    facts = _facts(numbered, _is_done(F.col("line"))).select(*KEY, "stop_at")
    data = F.try_parse_json(_payload(F.col("line")))
    deltas = F.try_variant_get(data, "$.choices[0].delta.tool_calls", "array<variant>")
    rows = numbered.join(facts, KEY).filter(_kept()).select(
        *KEY, "line_no", F.posexplode(deltas).alias("pos", "call")
    )

    def member(path: str, kind: str = "string") -> Column:
        return F.try_variant_get("call", path, kind)

    calls = derive(
        rows, [*KEY, "line_no", "pos"],
        call_index=F.coalesce(member("$.index", "int"), F.lit(0)),
        id=F.nullif(member("$.id"), F.lit("")),
        name=F.nullif(member("$.function.name"), F.lit("")),
        arguments=member("$.function.arguments"),
    )

    def last_given(name: str) -> Column:
        given = F.struct("line_no", "pos", F.col(name).alias("value"))
        return F.max(F.when(F.col(name).isNotNull(), given)).alias(name)

    in_part = calls.groupBy(*KEY, "call_index").agg(
        last_given("id"), last_given("name"),
        _ordered_text(F.col("arguments"), "line_no", "pos").alias("arguments"),
    )
    return in_part.groupBy("request_id", "call_index").agg(
        F.coalesce(F.max("id")["value"], F.lit("")).alias("id"),
        F.coalesce(F.max("name")["value"], F.lit("")).alias("name"),
        _checked(_ordered_text(F.col("arguments"), "part_no")).alias("arguments"),
    )


def stream_tool_calls_blocks(lines: DataFrame, part_lines: int = PART_LINES) -> DataFrame:
    """CH15: tool calls by block index. Argument text belongs to the block last
    started, not to the index on its own line; starting an index again resets it."""
    numbered = _with_part(lines, part_lines)
    data = F.try_parse_json(_payload(F.col("line")))
    maybe_start = F.when(F.contains(F.col("line"), F.lit("content_block_start")), data)
    started = F.when(
        F.try_variant_get(maybe_start, "$.type", "string") == "content_block_start",
        F.coalesce(F.try_variant_get(maybe_start, "$.index", "bigint"), F.lit(0)),
    )
    facts = _facts(numbered, _is_message_stop(F.col("line")), started)
    events = derive(
        numbered.join(facts, KEY).filter(_kept()), [*KEY, "line_no", "carried"], data=data,
    )

    def member(path: str, kind: str = "string") -> Column:
        return F.try_variant_get("data", path, kind)

    is_start = member("$.type") == "content_block_start"
    fields = derive(
        events, [*KEY, "line_no", "carried"],
        started=F.when(is_start, F.coalesce(member("$.index", "bigint"), F.lit(0))),
        opens_tool=is_start & (member("$.content_block.type") == "tool_use"),
        id=member("$.content_block.id"),
        name=member("$.content_block.name"),
        piece=F.when(
            (member("$.type") == "content_block_delta")
            & (member("$.delta.type") == "input_json_delta"),
            member("$.delta.partial_json"),
        ),
    )
    so_far = W.partitionBy(*KEY).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    current = F.coalesce(F.last("started", ignorenulls=True).over(so_far), F.col("carried"))
    opened_at = F.when(F.col("opens_tool"), F.col("line_no"))
    piece = F.when(F.col("piece").isNotNull(), F.struct("line_no", "piece"))
    blocks = fields.withColumn("block_index", current).filter(
        F.col("block_index").isNotNull() & (F.col("opens_tool") | F.col("piece").isNotNull())
    ).groupBy(*KEY, "block_index").agg(
        F.max(opened_at).alias("opened_at"),
        F.max_by("id", opened_at).alias("id"),
        F.max_by("name", opened_at).alias("name"),
        F.array_sort(F.collect_list(piece)).alias("pieces"),
    )
    after_open = F.filter(
        F.col("pieces"), lambda p: F.coalesce(p["line_no"] > F.col("opened_at"), F.lit(True))
    )
    text = F.array_join(F.transform(after_open, lambda p: p["piece"]), "")
    opening = F.struct("opened_at", "part_no", "id", "name")
    whole = blocks.withColumn("text", text).groupBy("request_id", "block_index").agg(
        F.max(F.when(F.col("opened_at").isNotNull(), opening)).alias("opened"),
        F.array_sort(F.collect_list(F.struct("part_no", "text"))).alias("parts"),
    )
    # What came before the part that last opened the block belonged to an earlier call.
    rest = F.filter("parts", lambda p: p["part_no"] >= F.col("opened.part_no"))
    return whole.filter(F.col("opened").isNotNull()).select(
        "request_id", "block_index", F.coalesce("opened.id", F.lit("")).alias("id"),
        F.coalesce("opened.name", F.lit("")).alias("name"),
        _checked(F.array_join(F.transform(rest, lambda p: p["text"]), "")).alias("arguments"),
    )


def stream_tool_calls_merge(lines: DataFrame) -> DataFrame:
    """CH16: calls of one name merge; a later value of an argument replaces the earlier.

    Arguments are merged one by one before they are put together, so many calls of
    one name are combined before the shuffle. `first_line` orders the calls.
    """
    parts = F.try_variant_get(
        F.try_parse_json("line"), "$.candidates[0].content.parts", "array<variant>"
    )
    rows = lines.select("request_id", "line_no", F.posexplode(parts).alias("pos", "part"))

    def member(path: str, kind: str) -> Column:
        return F.try_variant_get("part", path, kind)

    calls = derive(
        rows.filter(member("$.text", "variant").isNull()), ["request_id", "line_no", "pos"],
        name=member("$.functionCall.name", "string"),
        args=member("$.functionCall.args", "map<string,variant>"),
    ).filter(F.col("name").isNotNull())
    values = calls.select(
        "request_id", "line_no", "pos", "name", F.posexplode_outer("args").alias("nth", "key", "value")
    )
    at = F.struct("line_no", "pos")
    merged = values.groupBy("request_id", "name", "key").agg(
        F.max_by(F.to_json("value"), at).alias("value"),
        F.min(F.struct("line_no", "pos", "nth")).alias("seen"),
    )
    member_text = F.concat(as_json(F.col("key")), F.lit(":"), F.col("value"))
    entry = F.when(F.col("key").isNotNull(), F.struct("seen", member_text.alias("text")))
    return merged.groupBy("request_id", "name").agg(
        F.min("seen.line_no").alias("first_line"),
        F.array_sort(F.collect_list(entry)).alias("entries"),
    ).select(
        "request_id", "first_line", F.col("name").alias("id"), "name",
        F.concat(
            F.lit("{"), F.array_join(F.transform("entries", lambda e: e["text"]), ","), F.lit("}")
        ).alias("arguments"),
    )
