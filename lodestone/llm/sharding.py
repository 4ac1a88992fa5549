"""Consistent sharding by a permutation-filled lookup table, in DataFrame functions only.

Every shard has its own order of preference over the slots of a prime-sized table; shards take turns, each claiming the
first slot it prefers that is still free, until none is. A key's slot is its hash modulo the table's size, so placement
is one lookup in a table whose size is a parameter (at most MOST_SLOTS rows), which is why it may be broadcast.

A null key is placed as the empty string is. Equal keys share a shard. Further columns pass through untouched; the
result's own columns are named by parameters, and a clash is refused. An empty table gives an empty result.
"""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARDS, SLOTS, MOST_SLOTS = 64, 6553, 1_000_003


def _number(text: str) -> int:
    return int(md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: int = SHARDS, slots: int = SLOTS) -> list[int]:
    """The shard of each slot. slots has to be prime, so that every step size visits all slots."""
    if not 0 < shards <= slots <= MOST_SLOTS or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots has to be a prime of at least as many as shards")
    at = [_number(f"offset-{s}") % slots for s in range(shards)]
    step = [_number(f"skip-{s}") % (slots - 1) + 1 for s in range(shards)] if slots > 2 else [1] * shards
    owner, free = [-1] * slots, slots
    while free:
        for s in range(shards):
            while owner[at[s]] >= 0:
                at[s] = (at[s] + step[s]) % slots
            owner[at[s]] = s
            free -= 1
            if not free:
                break
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % F.lit(slots)


def sharded(df: DataFrame, key: str = "doc_id", shards: int = SHARDS, slots: int = SLOTS, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """df with each row's slot and shard; no shuffle."""
    if {slot, shard} & set(df.columns):
        raise ValueError(f"df already has a column {slot} or {shard}")
    listed = ",".join(map(str, lookup_table(shards, slots)))
    table = df.sparkSession.range(1).select(F.posexplode(F.split(F.lit(listed), ",")).alias(slot, shard)).select(F.col(slot).cast("long"), F.col(shard).cast("int"))
    return df.withColumn(slot, slot_of(F.col(key), slots)).join(F.broadcast(table), slot, "left").select(*df.columns, slot, shard)


def write_sharded(df: DataFrame, path: str, key: str = "doc_id", files_per_shard: int = 1, **table) -> None:
    """Writes df as one folder for each shard. Rows of one shard are dealt over files_per_shard tasks, whatever their keys."""
    out = sharded(df, key, **table)
    salt = F.pmod(F.xxhash64(*[c for c, kind in df.dtypes if kind not in ("variant",) and not kind.startswith("map")]), F.lit(files_per_shard))
    out.repartition(F.col("shard"), salt).write.partitionBy("shard").parquet(path)
