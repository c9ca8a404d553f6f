"""Tables that cut the lineage of iterative operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir`` that goes when the session ends.

    Where that is unset, a local master gets a temporary folder; on a cluster no folder is known to be shared.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        base = f"file://{tempfile.gettempdir()}/arterial"
    root = f"{base.rstrip('/')}/{spark.sparkContext.applicationId}-road-{uuid.uuid4().hex}"

    def clean() -> None:
        context = spark.sparkContext
        if context._jsc is not None:
            path = context._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)

    atexit.register(clean)
    return root


def storer(spark: SparkSession) -> Callable[..., DataFrame]:
    """Writes a frame to a folder of its own, parted by the columns given, and reads it back."""
    root = folder(spark)

    def store(df: DataFrame, *by: str) -> DataFrame:
        path = f"{root}/{uuid.uuid4().hex}"
        df.write.partitionBy(*by).parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return store
