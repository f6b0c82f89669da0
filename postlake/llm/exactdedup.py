"""Exact deduplication by counting quotient filters, merged losslessly, with byte verification.

A text's fingerprint is a 64-bit hash of its normalised form (every character of
`[\\x20\\x09-\\x0D]` deleted). Its top QUOTIENT_BITS bits are the quotient, the rest the
remainder. Every partition builds its own counting quotient filter: the sorted, distinct
(quotient, remainder) pairs of its rows with their counts. Filters merge without loss
because no bit of a fingerprint is dropped: entries of equal (quotient, remainder) add
their counts. A hot text thus contributes one entry per partition, never one per row.

Only rows whose fingerprint counts above one go on to byte verification. They are found
without moving texts: the fingerprints above one set bits of a membership table of
2^MEMBER_BITS bits (a fixed size, whatever the input), which is broadcast and joined
with every row in place. Rows that pass (true copies, and few others that share a bit)
are grouped by their fingerprint and their whole normalised bytes, so equal texts are
told by comparing bytes, not hashes. Groups report their size and keeper; rows learn
them by a join on (fingerprint, SHA-256), in which groups above HOT_ROWS rows are
broadcast (at most rows / HOT_ROWS of them, a proven bound) and the rest are shuffled
with at most HOT_ROWS rows to a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from postlake.llm.words import map_texts
from postlake.sources.scratch import cut_lineage

#: Top bits of a fingerprint that are its quotient; the remaining 64 - QUOTIENT_BITS are its remainder.
QUOTIENT_BITS = 24
#: Bits of the broadcast membership table of fingerprints counted more than once (2^24 bits = 2 MB).
MEMBER_BITS = 24
#: Groups of more rows than this learn their keeper by broadcast, not by a shuffle on their key.
HOT_ROWS = 100_000
#: Characters deleted before texts are compared: space and tab to carriage return.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"

FILTER = "quotient long, remainder long, count long"


def normalised(text: Column) -> Column:
    """The text without white space; NULL counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS, "")


def exact_duplicates(docs: DataFrame, text: str = "text", hot_rows: int = HOT_ROWS,
                     member_bits: int = MEMBER_BITS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised forms are byte for byte equal; NULL and empty
    texts and texts of white space only are all equal to one another. Of equal texts the
    row with the most code points in its original text stays, then the least doc_id; a NULL
    doc_id comes after every other on ties (and is kept only where its group has no other
    row first). `kept` is true for exactly the row whose doc_id equals keep_id (NULL-safe).
    Repeated rows of one doc_id are separate rows of one group; the first of them stays and
    the others report kept true as well, since they carry the same id. Other columns of
    `docs` are left out. An empty table gives an empty result.
    """
    prints = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.char_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_points"),
        normalised(F.col(text)).alias("norm"),
    ).select("doc_id", "n_points", F.xxhash64("norm").alias("fp"), F.sha2("norm", 256).alias("text_sha256"))
    # Thin rows are written once: the filters and the final join read them, not the texts.
    prints = cut_lineage(prints, "exact-prints")

    merged = merged_filter(prints.select("fp"))
    repeated = merged.where(F.col("count") > 1).select(
        F.shiftleft("quotient", 64 - QUOTIENT_BITS).bitwiseOR(F.col("remainder")).alias("fp"))
    # Both are read twice below; written once, neither the filters nor the byte groups run again.
    members = cut_lineage(_membership(repeated, member_bits), "exact-members")

    # Rows whose fingerprint is surely single are their own group.
    marked = _marked(prints, members, member_bits)
    single = marked.where(~F.col("candidate")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")

    # Byte verification: candidates are grouped by their whole normalised bytes.
    candidates = _marked(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.char_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_points"),
        normalised(F.col(text)).alias("norm"),
    ).withColumn("fp", F.xxhash64("norm")), members, member_bits).where("candidate")
    groups = candidates.groupBy("fp", "norm").agg(
        F.count(F.lit(1)).alias("group_size"),
        F.max_by("doc_id", F.struct("n_points", (-F.col("doc_id")))).alias("keep_id"),
    ).select("fp", F.sha2("norm", 256).alias("text_sha256"), "group_size", "keep_id")
    groups = cut_lineage(groups, "exact-groups")

    rows = marked.where("candidate").select("doc_id", "fp", "text_sha256")
    hot = groups.where(F.col("group_size") > hot_rows)
    key = ["fp", "text_sha256"]
    in_hot = rows.join(F.broadcast(hot), key, "inner")
    in_cold = rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(
        groups.where(F.col("group_size") <= hot_rows), key, "inner")
    verified = in_hot.unionByName(in_cold).select("doc_id", "keep_id", "group_size", "text_sha256")

    out = single.unionByName(verified)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                      "text_sha256")


def merged_filter(fingerprints: DataFrame) -> DataFrame:
    """Per-partition counting quotient filters of the `fp` column, merged: quotient, remainder, count.

    The build runs in every task on its own rows; the merge adds the counts of equal
    (quotient, remainder) entries, which Spark does as a grouping with map-side combine.
    """
    return map_texts(fingerprints, _build_filters, FILTER).groupBy("quotient", "remainder").agg(
        F.sum("count").alias("count"))


def _build_filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One counting quotient filter of all batches of a partition, as sorted runs of remainders."""
    parts = [b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for b in batches]
    if not parts:
        return
    prints, counts = np.unique(np.concatenate(parts), return_counts=True)
    shift = np.uint64(64 - QUOTIENT_BITS)
    quotient = (prints >> shift).astype(np.int64)
    remainder = (prints & np.uint64((1 << (64 - QUOTIENT_BITS)) - 1)).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(quotient), pa.array(remainder), pa.array(counts.astype(np.int64))],
                                     names=["quotient", "remainder", "count"])


def _slot(fp: Column, member_bits: int) -> Column:
    return F.shiftrightunsigned(fp, 64 - member_bits)


def _membership(repeated: DataFrame, member_bits: int) -> DataFrame:
    """Words of the membership table: word, bits; at most 2^(member_bits - 6) rows."""
    slots = repeated.select(_slot(F.col("fp"), member_bits).alias("slot"))
    return slots.select(F.shiftright("slot", 6).alias("word"), F.expr("shiftleft(1L, CAST(slot & 63 AS INT))").alias(
        "bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def _marked(rows: DataFrame, members: DataFrame, member_bits: int) -> DataFrame:
    """`rows` with `candidate`: the fingerprint's bit is set in the membership table."""
    keyed = rows.withColumn("slot_", _slot(F.col("fp"), member_bits)).withColumn("word", F.shiftright("slot_", 6))
    joined = keyed.drop("bits").join(F.broadcast(members), "word", "left")
    bit = F.expr("shiftrightunsigned(bits, CAST(slot_ & 63 AS INT)) & 1")
    return joined.withColumn("candidate", F.coalesce(bit == 1, F.lit(False))).drop("word", "bits", "slot_")
