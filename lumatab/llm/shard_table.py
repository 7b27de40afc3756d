"""Sharding by a permutation-filled lookup table (operator 4).

Each shard has its own order of preference over the slots of a prime-sized table, an arithmetic walk set by
two hashes of its name. Shards take turns; at its turn a shard claims its next free slot, until all slots
are claimed. Slots per shard then differ by at most one (in proportion to weights, if given), and adding or
removing a shard moves few slots. A row's slot is a hash of its key modulo the table size, so placement is
one lookup in a broadcast array whose size is the parameter `slots`.

Defined cases: a null key is placed like an empty one; repeated rows go to the same shard; other columns
are carried along untouched by `place`; an empty table stays empty; names must be distinct.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Largest table that is broadcast: 4 MB, whatever the data.
MAX_SLOTS = 1 << 20


def _prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _hash(seed: str, name: str) -> int:
    return int(hashlib.md5(f"{seed}:{name}".encode()).hexdigest()[:15], 16)


def fill(shards: list[str], slots: int = 65_537, weights: list[int] | None = None) -> list[int]:
    """For each slot the index of the shard that claimed it. A shard of weight w has w turns a round."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names")
    if not _prime(slots) or not len(shards) <= slots <= MAX_SLOTS:
        raise ValueError(f"slots must be a prime from the number of shards to {MAX_SLOTS}")
    weights = weights or [1] * len(shards)
    if len(weights) != len(shards) or min(weights) < 1:
        raise ValueError("one weight of at least 1 for each shard")
    at = [_hash("offset", s) % slots for s in shards]
    step = [_hash("skip", s) % (slots - 1) + 1 for s in shards]
    table, left = [-1] * slots, slots
    while True:
        for i, w in enumerate(weights):
            for _ in range(w):
                while table[at[i]] >= 0:
                    at[i] = (at[i] + step[i]) % slots
                table[at[i]] = i
                left -= 1
                if not left:
                    return table


def slot_of(key: Column, slots: int) -> Column:
    """60 bits of the key's md5, modulo the number of slots."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("bigint") % slots


def place(docs: DataFrame, shards: list[str], key: str = "doc_id", slots: int = 65_537, weights: list[int] | None = None, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """docs with slot and shard (names that must be free). One narrow projection: the table travels as a literal, no join and no shuffle."""
    if clash := {slot_col, shard_col} & set(docs.columns):
        raise ValueError(f"columns exist: {sorted(clash)}; choose slot_col and shard_col")
    width = 4 if len(shards) > 1 << 16 else 2
    packed = b"".join(i.to_bytes(width, "big") for i in fill(shards, slots, weights))  # a slice of bytes takes constant time, unlike one of text
    out = docs.withColumn(slot_col, slot_of(F.col(key), slots))
    index = F.conv(F.hex(F.substring(F.lit(packed), F.col(slot_col).cast("int") * width + 1, F.lit(width))), 16, 10).cast("int")
    return out.withColumn(shard_col, F.element_at(F.lit(list(shards)), index + 1))


def write_placed(placed: DataFrame, path: str, shard_col: str = "shard", rows_per_file: int = 1_000_000) -> None:
    """One folder a shard. A shard's rows may come from many tasks and go to many files, so no shard is one task."""
    placed.write.option("maxRecordsPerFile", rows_per_file).partitionBy(shard_col).parquet(path)


def read_placed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of all shards, from the files alone; an empty table has none."""
    return spark.read.schema(schema).parquet(path).select(schema.names)


SHARDS = [f"shard-{i:03d}" for i in range(64)]


def oracle(shards: list[str] = SHARDS, slots: int = 65_537) -> str:
    """DuckDB SQL for a placement by the filled table; tests hold the filling against a plain simulation."""
    table = ",".join(map(str, fill(shards, slots)))
    names = ",".join(f"'{s}'" for s in shards)
    return f"""WITH t AS (SELECT [{table}] AS slots, [{names}] AS names),
    d AS (SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT % {slots} AS slot FROM documents)
    SELECT doc_id, slot, names[slots[slot + 1] + 1] AS shard FROM d, t"""
