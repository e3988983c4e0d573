"""Sharding by an external shuffle of two passes, in DataFrame operations only.

Pass one scatters the records: a seeded hash of the record's place in the input picks a
bucket, whatever the record holds, so equal rows spread as well as any.  There are as
many buckets as keep one of them at about ``bucket_bytes``.  Pass two permutes each
bucket in memory with Spark's ``shuffle`` function, which is a seeded Fisher-Yates
shuffle, and deals the records out: with the records of all earlier buckets counted
first, the record of rank r goes to shard ``r mod shards`` as its number ``r div shards``.
So shards differ by at most one record (law ``rows``), and the records of a shard are
numbered without gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a bucket holds on average, in bytes of its records.
BUCKET_BYTES = 4 << 20
#: Buckets whose counts are added up in one group.
GROUP = 1024


def shards(df: DataFrame, n_shards: int, size: Column, seed: int = 19, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Whole records as ``record``, with ``shard`` (int) and ``slot`` (long).

    ``size`` is the number of bytes of a record.  Nothing is looked at but sizes, so nulls,
    repeated rows and columns of any name are records like others; an empty table gives
    none.  A record larger than a bucket makes its bucket as large.  The result depends on
    the seed and on how the input is split, not on which executor does what.
    """
    total = df.agg(F.sum(size.cast("long"))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    place = F.monotonically_increasing_id()
    placed = df.select(F.struct("*").alias("record"), place.alias("_llm_place"))
    placed = placed.withColumn("_llm_bucket", F.pmod(F.xxhash64(F.lit(seed), "_llm_place"), F.lit(buckets)))
    tasks = max(1, min(buckets, 1 << 16))
    dealt = placed.repartition(tasks, "_llm_bucket")
    counts = placed.groupBy("_llm_bucket").count().withColumn("_llm_group", F.floor(F.col("_llm_bucket") / GROUP))
    groups = counts.groupBy("_llm_group").agg(F.sum("count").alias("_llm_n"))
    before_group = Window.orderBy("_llm_group").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("_llm_group").orderBy("_llm_bucket").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("_llm_group", F.coalesce(F.sum("_llm_n").over(before_group), F.lit(0)).alias("_llm_g"))
    starts = counts.withColumn("_llm_b", F.coalesce(F.sum("count").over(before), F.lit(0))).join(groups, "_llm_group")
    starts = starts.select("_llm_bucket", (F.col("_llm_g") + F.col("_llm_b")).alias("_llm_start"))
    # in a bucket: sorted by place, so that the permutation starts from one order, then permuted
    held = dealt.groupBy("_llm_bucket").agg(F.array_sort(F.collect_list(F.struct("_llm_place", "record"))).alias("_llm_held"))
    mixed = held.join(starts, "_llm_bucket").select("_llm_start", F.posexplode(F.expr(f"shuffle(_llm_held, {int(seed)}L)")).alias("_llm_pos", "_llm_one"))
    rank = F.col("_llm_start") + F.col("_llm_pos")
    return mixed.select(F.col("_llm_one.record").alias("record"), F.pmod(rank, F.lit(n_shards)).cast("int").alias("shard"), F.floor(rank / n_shards).cast("long").alias("slot"))


def write(sharded: DataFrame, path: str) -> None:
    """The shards as Parquet folders ``shard=0``, ..., each in the order of its slots."""
    sharded.select("record.*", "shard", "slot").repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
