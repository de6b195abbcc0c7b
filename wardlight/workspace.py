"""Intermediate tables in the cluster's shared folder.

Iterative operators write each step as Parquet and read it back.  That cuts the
lineage, resets the optimizer's size estimates and survives the loss of any
executor, because the files lie in the folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_fallback_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session; a temporary one only where none is configured."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback_dirs:
        _fallback_dirs[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _fallback_dirs[app]


class Workspace:
    """A run's folder of written tables below :func:`shared_dir`.

    Returned DataFrames read from it lazily, so the caller closes it only after the
    last action on any result.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/wardlight/{uuid.uuid4().hex}"

    def write(self, df: DataFrame, label: str) -> DataFrame:
        """Write ``df`` once and return a DataFrame that reads the written files."""
        path = f"{self.root}/{label}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        """Delete the run's folder."""
        hadoop_path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = hadoop_path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.delete(hadoop_path, True)
