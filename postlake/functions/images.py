"""Image format sniffing and message parts that carry images (CH7, CH8)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from postlake.functions.compose import let

SNIFFED_CHARS = 20
# Leading bytes in hex, then the format they mean. WEBP has its mark
# after an eight-byte header.
MAGIC = [("^FFD8FF", "jpeg"), ("^89504E47", "png"), ("^474946", "gif"), ("^.{16}57454250", "webp")]
DEFAULT_FORMAT = "png"


def image_data(image: Column) -> Column:
    """The base64 payload without a data-URL prefix."""
    return F.substring_index(image, ",", -1)


def _sniffed(image: Column) -> Column:
    head = F.substring(image_data(image), 1, SNIFFED_CHARS)

    def named(leading: Column) -> Column:
        found = [F.when(leading.rlike(mark), F.lit(name)) for mark, name in MAGIC]
        return F.coalesce(*found, F.lit(DEFAULT_FORMAT))

    return let(F.hex(F.try_to_binary(head, F.lit("base64"))), named)


def _declared(image: Column) -> Column:
    return F.startswith(image, F.lit("data:image/"))


def image_mime(image: Column) -> Column:
    """CH7: MIME type; a data-URL prefix wins over the content."""
    declared = F.substring_index(F.substring_index(image, ";", 1), ":", -1)
    return F.when(_declared(image), declared).otherwise(
        F.concat(F.lit("image/"), _sniffed(image))
    )


def image_extension(image: Column) -> Column:
    """CH7: the same as a bare format name."""
    declared = F.substring_index(F.substring_index(image, ";", 1), "/", -1)
    return F.when(_declared(image), declared).otherwise(_sniffed(image))


def _json_parts(prompt: Column, text_part: Column, image_parts: Column, images_first: bool) -> Column:
    texts = F.when(
        F.coalesce(prompt, F.lit("")) != "", F.array(text_part)
    ).otherwise(F.array().cast("array<string>"))
    pictures = F.coalesce(image_parts, F.array().cast("array<string>"))
    both = F.concat(pictures, texts) if images_first else F.concat(texts, pictures)
    return F.concat(F.lit("["), F.array_join(both, ","), F.lit("]"))


def _typed_text(prompt: Column) -> Column:
    return F.to_json(F.struct(F.lit("text").alias("type"), prompt.alias("text")))


def content_openai(prompt: Column, images: Column) -> Column:
    """CH8: text first, images as data URLs. Also the form of the grok provider."""
    def part(image: Column) -> Column:
        url = F.concat(
            F.lit("data:image/"), image_extension(image), F.lit(";base64,"), image_data(image)
        )
        return F.to_json(F.struct(
            F.lit("image_url").alias("type"), F.struct(url.alias("url")).alias("image_url")
        ))
    return _json_parts(prompt, _typed_text(prompt), F.transform(images, part), False)


def content_claude(prompt: Column, images: Column) -> Column:
    """CH8: images first, as typed base64 sources."""
    def part(image: Column) -> Column:
        source = F.struct(
            F.lit("base64").alias("type"),
            image_mime(image).alias("media_type"),
            image_data(image).alias("data"),
        )
        return F.to_json(F.struct(F.lit("image").alias("type"), source.alias("source")))
    return _json_parts(prompt, _typed_text(prompt), F.transform(images, part), True)


def content_gemini(prompt: Column, images: Column) -> Column:
    """CH8: text first, images as inline data."""
    def part(image: Column) -> Column:
        data = F.struct(image_mime(image).alias("mime_type"), image_data(image).alias("data"))
        return F.to_json(F.struct(data.alias("inline_data")))
    text = F.to_json(F.struct(prompt.alias("text")))
    return _json_parts(prompt, text, F.transform(images, part), False)
