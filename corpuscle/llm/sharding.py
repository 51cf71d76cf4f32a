"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a table of prime size: slot j of its preference is (offset + j * skip) modulo the size, offset and skip
from hashes of its name.  The shards take turns; each claims the first slot of its preference that is still free, until all are taken.  All shards
get the same number of slots, give or take one, and when a shard joins or leaves few other slots change hands.  The table is of fixed size, so it is always broadcast:
placing a document is one hash and one lookup, without a shuffle.

The key is the id together with a digest of the text: a single id with a large part of all rows is spread over the shards too, unless the texts are equal.

Edge cases: null ids and null texts count as empty strings in the key; equal rows go to the same shard; a column named like an output gives way to it under ``replace``,
otherwise the output takes a free name; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .frames import col, free_name

SLOTS = 4099            # prime, and well above 100 slots per shard
SHARDS = tuple(f"shard-{i:02d}" for i in range(16))


def _number(text: str, part: int) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[15 * part:15 * part + 15], 16)


def lookup_table(shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> list[int]:
    """Index of the shard that owns each slot."""
    if slots < 2 or any(slots % k == 0 for k in range(2, int(slots ** 0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    if not shards or len(shards) > slots:
        raise ValueError("between one shard and one per slot")
    offset = [_number(s, 0) % slots for s in shards]
    skip = [_number(s, 1) % (slots - 1) + 1 for s in shards]
    at, owner = list(offset), [-1] * slots
    for claim in range(slots):
        s = claim % len(shards)
        while owner[at[s]] >= 0:
            at[s] = (at[s] + skip[s]) % slots
        owner[at[s]] = s
    return owner


def slot(id: Column, text: Column, slots: int = SLOTS) -> Column:
    key = F.md5(F.concat(F.coalesce(id.cast("string"), F.lit("")), F.lit("/"), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(key, 1, 15), 16, 10).cast("long") % slots


def shard(documents: DataFrame, id: str = "doc_id", text: str = "text", shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """The documents with columns ``slot`` and ``shard`` (with underscores before the name where it is taken)."""
    names = documents.columns
    slot_name, shard_name = free_name(names, "slot"), free_name(names, "shard")
    table = documents.sparkSession.createDataFrame([(i, shards[s]) for i, s in enumerate(lookup_table(shards, slots))], f"{slot_name} long, {shard_name} string")
    placed = documents.withColumn(slot_name, slot(col(id), col(text), slots))
    return placed.join(F.broadcast(table), slot_name).select(*map(col, names), slot_name, shard_name)
