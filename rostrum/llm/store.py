"""Intermediate tables in the folder that the cluster names for them."""
from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession, kind: str = "table") -> str:
    """A new path below ``spark.checkpoint.dir``.  A session on one machine
    without that setting gets a scratch folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="rostrum-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/rostrum-{kind}-{uuid.uuid4().hex}"


def shared_table(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again, so that
    what follows neither recomputes it nor loses it with an executor.  Shuffle
    files that only served the writing are removed at its end."""
    path = shared_folder(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """Inside, each query's shuffle files go when the query ends, not when the
    driver next collects its garbage."""
    old = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEAN) if old is None else spark.conf.set(_CLEAN, old)
