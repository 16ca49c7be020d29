"""Tables that cut lineage, in the folder that all executors share.

A written table survives the loss of any executor, unlike a local checkpoint,
and unlike ``DataFrame.checkpoint`` it is columnar and compressed.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only where none is named and all runs in one process."""
    named = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError(f"{SETTING} must name a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="rillmark-")
    atexit.register(shutil.rmtree, own, True)
    spark.conf.set(SETTING, f"file://{own}")
    return f"file://{own}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/rillmark-{name}-{uuid.uuid4().hex}"


def write(df: DataFrame, name: str) -> str:
    """Write ``df`` to a new table and return its path."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return it read back, without its lineage."""
    return df.sparkSession.read.schema(df.schema).parquet(write(df, name))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of this module that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
