"""Live windows over a stream of events, with late data. An extension: the batch operators have no counterpart."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltstream.session import checkpoint_dir


def live_counts(stream: DataFrame, time: str, minutes: int, malicious: Column, late: str = "10 minutes", slide: int | None = None) -> DataFrame:
    """(window_start, n, n_malicious) of tumbling, or with slide of overlapping, windows; rows later than ``late`` are
    dropped. Null times are left out."""
    rows = stream.where(F.col(time).isNotNull()).withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    window = F.window("_t", f"{minutes} minutes", f"{slide} minutes") if slide else F.window("_t", f"{minutes} minutes")
    counts = rows.groupBy(window.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(malicious, 1)).alias("n_malicious"))
    return counts.select(F.col("w.start").alias("window_start"), "n", "n_malicious")


def live_sessions(stream: DataFrame, key: str, time: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """(key, session_start, session_end, n) of each key's rows less than ``gap`` apart."""
    rows = stream.where(F.col(time).isNotNull() & F.col(key).isNotNull()).withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    made = rows.groupBy(key, F.session_window("_t", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return made.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def live_duplicates(stream: DataFrame, keys: list[str], time: str, late: str = "10 minutes") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def live_last_seen(stream: DataFrame, key: str, time: str) -> DataFrame:
    """(key, n, last_time, backward_steps): running state per key, as an update per batch; the live form of the
    backward transitions of the audit."""

    def update(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last, back = state.get if state.exists else (0, None, 0)
        for frame in frames:
            for t in frame["_us"]:
                back += int(last is not None and t < last)
                last = int(t)
                n += 1
        state.update((n, last, back))
        yield pd.DataFrame({"key": [group[0]], "n": [n], "last_us": [last], "backward_steps": [back]})

    kind = dict(stream.dtypes)[key]
    rows = stream.where(F.col(time).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.unix_micros(F.col(time).cast("timestamp")).alias("_us"))
    made = rows.groupBy("key").applyInPandasWithState(update, f"key {kind}, n bigint, last_us bigint, backward_steps bigint", "n bigint, last bigint, back bigint", "update", GroupStateTimeout.NoTimeout)
    return made.select(F.col("key").alias(key), "n", F.timestamp_micros("last_us").alias("last_time"), "backward_steps")


def run_once(stream: DataFrame, name: str, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """All that is available now, as a table in memory; for small results and tests."""
    writer = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def stream_of(spark: SparkSession, directory: str, name: str, files_per_batch: int = 1) -> DataFrame:
    """A table, one Parquet file or a folder of them, as a stream of its files."""
    path = f"{directory}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    # a stream reads folders; a single file is picked from its folder by name
    folder = os.path.isdir(path.removeprefix("file:"))
    return reader.parquet(path) if folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(directory)


def written_once(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """All that is available now, as a table in the shared folder: the last batch of complete mode replaces those
    before it, so a batch run again after a failure changes nothing."""
    spark = stream.sparkSession
    place = f"{checkpoint_dir(spark)}/live-{uuid.uuid4().hex}"
    batches: list[str] = []

    def write(batch: DataFrame, number: int) -> None:
        path = f"{place}/out/{number}"
        batch.write.mode("overwrite").parquet(path)
        batches.append(path)

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if not batches:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(batches[-1]) if mode == "complete" else spark.read.schema(stream.schema).parquet(*batches)
