"""Sharding by a permutation-filled lookup table.

Every shard has its own preference order over the slots of a table of prime size. The shards
take turns; each claims the first slot of its order that is still free, until the table is
full. Shares differ by one slot at most, and a shard that joins or leaves moves little else.
A row's slot is a hash of its key, so placement is one lookup in a broadcast table of one row
a slot, whose size is a parameter and no matter of the input.

Defined results: a null key is placed by a key of its own. Repeated rows go to the same
shard. With `spread`, keys that hold more than that many rows are salted over as many slots
as they need, by a hash of their columns. Extra columns stay, whatever their names; an input's
own columns `slot` and `shard` are replaced, but may be the key. Empty tables stay empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 65_537


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], slots: int = SLOTS, weights: Sequence[int] | None = None) -> list[int]:
    """The index of the shard that holds each slot; a shard of weight w takes w slots a turn."""
    if not is_prime(slots) or slots < len(shards):
        raise ValueError("the table's size must be a prime that is not below the number of shards")
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names")
    at, skip = [], []
    for name in shards:
        h = hashlib.md5(name.encode()).digest()
        at.append(int.from_bytes(h[:8], "big") % slots)
        skip.append(int.from_bytes(h[8:], "big") % (slots - 1) + 1)
    table, left = [-1] * slots, slots
    while left:
        for i in range(len(shards)):
            for _ in range(weights[i] if weights else 1):
                if not left:
                    break
                while table[at[i]] >= 0:
                    at[i] = (at[i] + skip[i]) % slots
                table[at[i]] = i
                left -= 1
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The first 60 bits of the key's MD5, modulo the table's size; keys are taken as text."""
    text = F.coalesce(key.cast("string"), F.lit("\x00null"))
    return (F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % slots).cast("int")


def assign_shards(df: DataFrame, key: str, shards: Sequence[str], slots: int = SLOTS, weights: Sequence[int] | None = None, spread: int | None = None) -> DataFrame:
    """`df` with the columns slot and shard (a name). Whole rows stay where they are; nothing is shuffled.

    `spread`: a key with more rows than that is salted by ceil(rows / spread); its rows are
    dealt by a hash of all columns. Heavy keys are found by a combining count."""
    table = lookup_table(shards, slots, weights)
    taken = {c.lower() for c in df.columns}
    own = lambda name: next(x for x in (name + "_" * n for n in range(len(taken) + 1)) if x not in taken)
    k, n, salt, slot, name = map(own, ("key_of_row", "salts", "salt", "slot_of_row", "shard_of_row"))
    rest = [F.col(f"`{c}`") for c in df.columns if c not in ("slot", "shard")]
    rows = df.withColumn(k, F.col(f"`{key}`").cast("string"))
    if spread:
        heavy = rows.groupBy(k).count().where(F.col("count") > spread).select(F.col(k).alias(k + "h"), F.ceil(F.col("count") / spread).alias(n))
        rows = rows.join(heavy, F.col(k).eqNullSafe(F.col(k + "h")), "left").withColumn(salt, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.coalesce(n, F.lit(1))))
        rows = rows.withColumn(k, F.when(F.col(salt) > 0, F.concat(F.coalesce(k, F.lit("\x00null")), F.lit("\x00"), F.col(salt).cast("string"))).otherwise(F.col(k)))
    # `slots` rows of 12 bytes: a size that no input changes
    look = df.sparkSession.createDataFrame([(i, shards[x]) for i, x in enumerate(table)], f"{slot} int, {name} string").coalesce(1)
    placed = rows.withColumn(slot, slot_of(F.col(k), slots)).join(F.broadcast(look), slot, "left")
    return placed.select(*rest, F.col(slot).alias("slot"), F.col(name).alias("shard"))


def write_shards(df: DataFrame, path: str) -> None:
    """Files by shard, as assign_shards names them."""
    df.write.partitionBy("shard").parquet(path)
