"""Shared working storage: where level tables are written to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A local session without the setting gets a folder of its own.  On a cluster
    the setting is required: a folder of one machine would not survive the loss
    of that machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        if base.startswith("file:") and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must be a folder that all executors share, not a local one")
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = "file://" + tempfile.mkdtemp(prefix="grovelight-")
    return _local_dirs[app]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in shared storage and return its scan.

    Besides cutting lineage, the scan carries true sizes, so joins against a
    small table are broadcast by the planner's own size check and stay shuffled
    when the table is large.
    """
    return write_table(df, f"{session_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}")


def session_dir(spark: SparkSession) -> str:
    return f"{work_dir(spark)}/grovelight/{spark.sparkContext.applicationId}"


def write_table(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Folder:
    """Working tables of one fitted set, which can be removed together."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{session_dir(spark)}/set-{uuid.uuid4().hex}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """Like :func:`cut`, but into this folder."""
        return write_table(df, f"{self.path}/{name}-{uuid.uuid4().hex}")

    def _file_system(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), at

    def exists(self) -> bool:
        files, at = self._file_system()
        return files.exists(at)

    def remove(self) -> None:
        """Delete all tables; the DataFrames that read them are of no use afterwards."""
        files, at = self._file_system()
        files.delete(at, True)
