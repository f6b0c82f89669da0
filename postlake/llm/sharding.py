"""Shard placement by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

#: Fixed value: a prime number of slots, far above the number of shards.
SLOTS = 65_537
SHARDS = 64
#: Hexadecimal digits of a digest that make a hash of at most 60 bits.
DIGITS = 15


def fill_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard number of every slot.

    Every shard prefers the slots in an order of its own: a start and a stride, both from
    its name. Shards take turns; each claims its most preferred slot that is still free.
    So every shard gets slots/len(shards) slots, give or take one, and adding or leaving
    out a shard moves few other slots. Takes about slots * ln(slots) steps, whatever the
    number of rows to place. `slots` must be prime and not below the number of shards.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named, and differently")
    if slots < max(2, len(shards)) or any(slots % k == 0 for k in range(2, int(slots ** 0.5) + 1)):
        raise ValueError("slots must be prime and not below the number of shards")
    place = [_digest("start/" + s) % slots for s in shards]
    stride = [_digest("stride/" + s) % (slots - 1) + 1 for s in shards]
    table, free = [-1] * slots, slots
    while True:
        for shard in range(len(shards)):
            at = place[shard]
            while table[at] >= 0:
                at = (at + stride[shard]) % slots
            table[at] = shard
            place[shard] = (at + stride[shard]) % slots
            free -= 1
            if not free:
                return table


def _digest(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:DIGITS], 16)


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: the head of its text's MD5. A NULL key is the empty text."""
    head = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, DIGITS)
    return F.pmod(F.conv(head, 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(docs: DataFrame, key: Column, shards: list[str], slots: int = SLOTS, prefix: str = "") -> DataFrame:
    """`docs` with the columns slot and shard (a number into `shards`) added.

    The table has `slots` rows of two numbers, whatever the data's size, and is broadcast; rows
    stay where they are. Equal keys share a shard; a hot key cannot be split this way,
    so place by a row's id rather than by its source. Columns of the same names are
    replaced unless `prefix` sets the new ones apart.
    """
    table = ",".join(map(str, fill_table(shards, slots)))
    slot, shard = f"{prefix}slot", f"{prefix}shard"
    lookup = docs.sparkSession.range(1).select(F.posexplode(F.split(F.lit(table), ",")).alias(slot, "text")).select(
        slot, F.col("text").cast("int").alias(shard))
    placed = docs.drop(slot, shard).withColumn(slot, slot_of(key, slots))
    return placed.join(F.broadcast(lookup), slot)


def write_shards(docs: DataFrame, key: Column, shards: list[str], path: str, files: int = 1) -> None:
    """Write every shard as its own folder of `files` Parquet files, rows dealt by their key."""
    placed = place(docs, key, shards)
    part = F.pmod(F.xxhash64(key), F.lit(files))
    placed.repartition(len(shards) * files, "shard", part).drop("slot").write.partitionBy("shard").parquet(path)
