"""The folder that the driver and all executors share, and frames written there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or where unset, below the warehouse."""
    own = f"{spark.conf.get('spark.sql.warehouse.dir')}/shelfmark-run"
    return spark.conf.get("spark.checkpoint.dir", None) or own


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder; the folder is removed when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(hadoop).deleteOnExit(place)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` from a table written now in the shared folder.

    For frames that are read several times: they are computed once, and a lost executor costs
    rereading, not recomputing.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
