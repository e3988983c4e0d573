"""What Python workers need to be started with."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def find_package(spark: SparkSession) -> None:
    """Python workers find this package also where it is not installed, and give back memory they have freed.

    Set before the first of them starts: workers of another environment are other processes,
    and those of before stay in memory beside them for a while.
    """
    settings = {"PYTHONPATH": str(Path(__file__).resolve().parents[2]), "ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1"}
    settings |= {"MALLOC_TRIM_THRESHOLD_": str(8 << 20), "MALLOC_MMAP_THRESHOLD_": str(8 << 20)}
    for name, value in settings.items():
        spark.sparkContext.environment.setdefault(name, value)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches are at most 2 MB unless it set a size itself.

    Rows are whole texts or packed ones: the default of 64 MB, held several times by either side, is more
    than a small executor has.
    """
    find_package(df.sparkSession)
    conf = df.sparkSession.conf
    if conf.get(BATCH_BYTES) in ("67108864", "67108864b", "64MB", "64m"):
        conf.set(BATCH_BYTES, "2m")
    return df
