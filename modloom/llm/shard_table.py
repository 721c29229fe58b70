"""Sharding by a permutation-filled lookup table.

Every shard prefers the slots of a prime-sized table in an order of its own (offset + i * skip, from two hashes of its name).
Shards take turns; each claims the first free slot of its order (`weight` slots a turn), until the table is full. A key's
hash names a slot, and the broadcast table, whose size is fixed, names its shard. Adding or losing a shard moves few slots
besides its own.

Defined results: a null key is placed as the empty string; repeated keys go to one shard; an empty table gives no rows;
further columns are ignored by the query and kept by `place`, which replaces columns named slot or shard.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS, SHARDS = 65_537, 64


def _hash(text: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{text}".encode()).hexdigest()[:15], 16)


def fill(names: list[str], slots: int = SLOTS, weights: list[int] | None = None) -> np.ndarray:
    """The shard number of every slot. slots must be prime and no less than the number of shards."""
    if slots < max(2, len(names)) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime number, at least as large as the number of shards")
    if not names:
        raise ValueError("there must be a shard")
    at = [_hash(n, "offset") % slots for n in names]
    skip = [_hash(n, "skip") % (slots - 1) + 1 for n in names]
    owner = [-1] * slots
    left = slots
    while True:
        for k in range(len(names)):
            for _ in range((weights or [1] * len(names))[k]):
                while owner[at[k]] >= 0:
                    at[k] = (at[k] + skip[k]) % slots
                owner[at[k]] = k
                left -= 1
                if not left:
                    return np.array(owner, np.int32)


def place(rows: DataFrame, key: str, owner: np.ndarray) -> DataFrame:
    """rows with the columns slot and shard: one hash and one look into the broadcast table for each."""
    rows = rows.drop("slot", "shard")
    table = rows.sparkSession.createDataFrame([(i, int(s)) for i, s in enumerate(owner)], "slot int, shard int")
    k = F.coalesce(F.col(key).cast("string"), F.lit(""))
    slot = F.pmod(F.conv(F.substring(F.md5(k.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(len(owner))).cast("int")
    return rows.withColumn("slot", slot).join(F.broadcast(table), "slot").select(*rows.columns, "slot", "shard")


def names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:04d}" for i in range(n)]


def op7_shard_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"))
    return place(docs, "doc_id", fill(names()))


def op7_sql() -> str:
    """The table stands in the SQL as a string with a character for each slot."""
    table = "".join(chr(48 + s) for s in fill(names())).replace("'", "''")
    return f"""
WITH d AS (SELECT doc_id, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % {SLOTS})::INT AS slot FROM documents)
SELECT doc_id, slot, (ascii(substr('{table}', slot + 1, 1)) - 48)::INT AS shard FROM d"""
