"""Sharding by jump consistent hashing: the key and the number of shards decide, without a table of rings.

When one shard is appended, a row stays or moves into the new shard.

Defined results: a null id is a key like any other; a null text has no bytes (its checksum is null);
rows that repeat an id share a shard; slots are gapless from 0 in every shard, in order of id, size and
checksum within a part of a shard, parts one after the other; a very long text only counts its bytes;
other columns are not read, so they cannot clash; an empty table gives no rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgate.llm.store import saved

#: Rows of a shard that one task numbers, about, and slots that one row is expanded to at once.
PART_ROWS = 100_000
RUN = 10_000


def jump(keys, shards):
    """Shard of each 64-bit key."""
    key = keys.astype(np.uint64)
    here, ahead = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    on = np.arange(len(key))
    while len(on):
        here[on] = ahead[on]
        key[on] = key[on] * np.uint64(2862933555777941757) + np.uint64(1)
        ahead[on] = ((here[on] + 1) * (2.0 ** 31 / ((key[on] >> np.uint64(33)).astype(float) + 1.0))).astype(np.int64)
        on = on[ahead[on] < shards]
    return here


def jump_shard(key_column, shards):
    """Shard number of a long column (null: as its hash)."""
    @F.arrow_udf("int")
    def of(key: pa.Array) -> pa.Array:
        return pa.array(jump(key.to_numpy(zero_copy_only=False).view(np.uint64), shards).astype(np.int32))

    return of(F.xxhash64(key_column))


def place(docs, shards=24, id_column="doc_id", text_column="text"):
    """(id, size, text_crc32, law, shard, slot, grown_shard) of every row.

    Equal rows are counted first and numbered together, and shards are numbered in parts, so neither a hot
    key nor a large shard meets in one task.
    """
    bytes_ = F.col(text_column).cast("binary")
    rows = docs.select(
        F.col(id_column), (F.coalesce(F.octet_length(bytes_), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(bytes_).alias("text_crc32"))
    counted = rows.groupBy(id_column, "size", "text_crc32").agg(F.count("*").alias("n"))
    counted = saved(counted.select(
        "*", jump_shard(F.col(id_column), shards).alias("shard"), jump_shard(F.col(id_column), shards + 1).alias("grown_shard")), "keys")
    total = counted.agg(F.sum("n")).head()[0] or 0
    parts = max(1, -(-total // (shards * PART_ROWS)))
    counted = counted.withColumn("part", F.pmod(F.xxhash64(id_column, "size", "text_crc32"), F.lit(parts)))
    sizes = counted.groupBy("shard", "part").agg(F.sum("n").alias("rows"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "part").orderBy(id_column, "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    numbered = counted.withColumn("first", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(offsets, ["shard", "part"])
    start = F.col("offset") + F.col("first")
    # equal rows come back one by one, a run of slots at a time
    runs = numbered.select(
        id_column, "size", "text_crc32", "shard", "grown_shard", "n", start.alias("start"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN))).alias("run"))
    slots = F.sequence(F.col("start") + F.col("run") * RUN, F.col("start") + F.least((F.col("run") + 1) * RUN, F.col("n")) - 1)
    return runs.select(id_column, "size", "text_crc32", F.lit("key").alias("law"), "shard", F.explode(slots).alias("slot"), "grown_shard")
