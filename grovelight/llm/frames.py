"""DataFrame helpers of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grovelight.plans.storage import cut
from grovelight.sources.packages import find_package, small_batches

__all__ = ["cut", "fold", "labelled_sample", "small_batches", "table", "with_label"]

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    find_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, per_class: int, seed: int, usable: Column) -> DataFrame:
    """At most ``per_class`` usable ids of either label (0 and 1), those of smallest seeded hash.

    An id with several labels counts as 1 if any of them is 1; null ids and labels are
    left out.  Returns (id, label), at most ``2 * per_class`` rows, which bounds what may
    be broadcast.
    """
    one = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & usable).groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))
    order = F.xxhash64(F.lit(seed), F.col(id_col))
    parts = [one.where(F.col("label") == k).orderBy(order, id_col).limit(per_class) for k in (0, 1)]
    return parts[0].unionByName(parts[1]).select(F.col(id_col), F.col("label"))


def with_label(docs: DataFrame, sample: DataFrame, id_col: str, how: str) -> DataFrame:
    """Documents with the labels of a bounded sample, without moving any text."""
    return docs.join(F.broadcast(sample), id_col, how)
