"""Session, table and shared-folder helpers used by every operator."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Narrow tables of at most this many rows may be broadcast, some 20 MB.
BROADCAST_ROWS = 200_000


def build_session(app: str = "siltstream", cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings every result assumes (UTC, ANSI, AQE).

    On a cluster the caller's own session is used instead; no operator calls this.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables (a file or a folder of files)."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session (spark.checkpoint.dir).

    Only where the session names none, as in local tests, a temporary folder of this machine is set; on a
    cluster without the setting this raises, as executors could not read one another's files.
    """
    context = spark.sparkContext
    found = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="siltstream-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage is cut and survives lost executors.

    Nothing deletes these tables while the result that reads them may still be lazy; the shared folder is
    the cluster's scratch space.
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df for the small side of a join: broadcast if it has at most ``most`` rows, else for a sort-merge join.

    The rows are counted, up to the bound; sizes that the engine takes from compressed files say little about memory.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("merge")
