"""The folder that driver and executors share, for tables and files that outlive a stage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: The folder of a local application that names none.
_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local folder only on a local master where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = _local.get(spark.sparkContext.applicationId) or tempfile.mkdtemp(prefix="spark-shared-")
        _local[spark.sparkContext.applicationId] = folder
    return folder.rstrip("/")


def written(df: DataFrame, name: str = "times") -> DataFrame:
    """Written in the shared folder and read back: cuts the lineage, outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def deleted(df: DataFrame) -> None:
    """Delete what ``written`` wrote, once nothing reads it any more."""
    jvm, session = df.sparkSession._jvm, df.sparkSession._jsparkSession
    path = jvm.org.apache.hadoop.fs.Path(df.written_path)
    path.getFileSystem(session.sessionState().newHadoopConf()).delete(path, True)
