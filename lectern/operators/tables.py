"""Tables in the shared folder, for operators that must read the same rows more than once.

All tables of an application lie in one folder below spark.checkpoint.dir, so that `clear` can delete them when nothing
reads them any more; it also runs when the driver's Python ends in the ordinary way.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OURS = "spark.lectern.tables"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, one of our own in local mode, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def _folder(spark: SparkSession) -> str:
    path = spark.conf.get(_OURS, None)
    if not path:
        path = f"{shared_dir(spark)}/lectern-{spark.sparkContext.applicationId}"
        spark.conf.set(_OURS, path)
        atexit.register(_last, spark)
    return path


def _last(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        clear(spark)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clear(spark: SparkSession) -> None:
    """Deletes all tables of this application; DataFrames that read them must be done with."""
    path = spark.conf.get(_OURS, None)
    if path:
        _delete(spark, path)


def fresh(spark: SparkSession, label: str) -> str:
    """A path in the application's folder that nothing else uses."""
    return f"{_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
