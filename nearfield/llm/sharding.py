"""Placing documents on shards with a permutation-filled lookup table.

Every shard has its own preference order over the slots of a prime-sized table; the shards take turns,
each claiming its next free slot, until the table is full. A key's hash picks a slot and the slot names
the shard, so a lookup is one array access and few keys move when a shard comes or goes.

The table's size is a parameter, not a function of the data, so it travels inside the plan. Placing a
row needs no shuffle, whatever the keys' frequencies.

Defined results: rows with the same key, null among them, get the same slot; an empty table gives no rows;
where docs have a column of an output's name, the output's gets an underscore more and docs keep theirs.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, hash60

#: A prime, over 100 times the shards, so that shares differ by less than a hundredth.
SLOTS = 6_569
SHARDS = 64


def _digest(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard's index for each slot."""
    if not shards or len(set(shards)) != len(shards) or slots < len(shards):
        raise ValueError("shards must be distinct, at least one, and no more than the slots")
    if any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    order = [(_digest(f"{s}#start") % slots, _digest(f"{s}#step") % (slots - 1) + 1) for s in shards]
    owner, turn, left = [-1] * slots, [0] * len(shards), slots
    while left:
        for i, (start, step) in enumerate(order):
            slot = (start + turn[i] * step) % slots
            while owner[slot] >= 0:
                turn[i] += 1
                slot = (start + turn[i] * step) % slots
            owner[slot] = i
            turn[i] += 1
            left -= 1
            if not left:
                break
    return owner


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i}" for i in range(n)]


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(hash60(F.coalesce(key.cast("string"), F.lit(""))), F.lit(slots)).cast("int")


def place(docs: DataFrame, key_col: str = "doc_id", shards: list[str] | None = None, slots: int = SLOTS, slot_name: str = "slot", shard_name: str = "shard") -> DataFrame:
    """docs with the slot and the shard's index of each row's key."""
    slot_name = free_name(docs, slot_name)
    shard_name = free_name(docs, shard_name)
    owner = lookup_table(shards or shard_names(), slots)
    table = F.array(*[F.lit(i) for i in owner]) if slots < 512 else F.split(F.lit(",".join(map(str, owner))), ",").cast("array<int>")
    return docs.withColumn(slot_name, slot_of(F.col(key_col), slots)).withColumn(shard_name, F.element_at(table, F.col(slot_name) + 1))
