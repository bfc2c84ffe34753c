"""Session defaults used by tests and the benchmark; a cluster brings its own."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows worth a task of their own after a shuffle.
TASK_ROWS = 4_096


def local_session(cpus: str = "8", memory: str = "12g", name: str = "rostrum") -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName(name)
             .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.rostrum.scan.parts", cpus if cpus.isdigit() else "8")
             .config("spark.sql.adaptive.skewJoin.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true")
             .config("spark.ui.enabled", "false")
             .config("spark.driver.memory", memory)
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new path below ``spark.checkpoint.dir``, under the rule of :func:`cut_lineage`."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return f"{(root or tempfile.mkdtemp(prefix='rostrum-shared-')).rstrip('/')}/rostrum-{kind}-{uuid.uuid4().hex}"


def packed(df: DataFrame, rows: int) -> DataFrame:
    """``df``, the outcome of a shuffle of about ``rows`` counted rows, in as
    many tasks as those rows are worth.  A shuffle dealt to many more partitions
    costs a start and a file each for a handful of rows; a large one stays as it
    was dealt."""
    tasks = max(1, -(-rows // TASK_ROWS))
    return df.coalesce(tasks) if tasks < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder of ``spark.checkpoint.dir``.

    Only a local session without that setting gets a scratch folder of its own;
    a cluster has to name one, as a folder of a single machine would be lost
    with it."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="rostrum-checkpoint-"))
    return df.checkpoint()
