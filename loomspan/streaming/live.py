"""Streams: paths that arrive as files are merged into the pair counts; windowed means of late events; a forward filter
whose state stays with its series. The reference point is batch only: these are extensions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomspan.kernels import filters
from loomspan.operators.paths import touched_pairs

POINT = "sid bigint, p int, roi int, length double"


def accumulate_pairs(spark: SparkSession, source: str, state: str, checkpoint: str) -> StreamingQuery:
    """Parquet files of whole paths (sid, p, roi, length) below ``source`` -> additive pair counts below ``state``. Each
    batch writes its own folder, named by its id, so a batch that is run again replaces itself."""

    def add(batch: DataFrame, batch_id: int) -> None:
        lengths = batch.groupBy("sid").agg(F.max("length").alias("length"))
        touched_pairs(batch, lengths).write.mode("overwrite").parquet(f"{state}/batch={batch_id}")

    stream = spark.readStream.schema(POINT).parquet(source)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pair_counts(spark: SparkSession, state: str) -> DataFrame:
    return spark.read.parquet(state).groupBy("i", "j").agg(F.sum("count").alias("count"), F.sum("lenw").alias("lenw"))


def windowed_means(events: DataFrame, width: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Streamed events (ts, user_id, value): mean of each user and window; rows later than ``late`` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "user_id").agg(F.avg("value").alias("mean"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), "user_id", "mean", "n")


def forward_filter(panel: DataFrame, tr: float, band: tuple[float, float]) -> DataFrame:
    """Streamed series (series string, t int, x double) through the filter forwards only (a filter without shift of phase
    needs the future): the filter's memory is the state of the series."""
    b, a = filters.butterworth(tr, band)
    order = len(a) - 1

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        memory = np.array(state.get[0]) if state.exists else np.zeros(order)
        rows = pd.concat(list(batches)).sort_values("t")
        out = []
        for x in rows["x"].to_numpy(float):
            y = b[0] * x + memory[0]
            memory = np.append(memory[1:], 0.0) + b[1:] * x - a[1:] * y
            out.append(y)
        state.update((memory.tolist(),))
        yield pd.DataFrame({"series": key[0], "t": rows["t"].to_numpy(np.int32), "y": out})

    return panel.groupBy("series").applyInPandasWithState(step, "series string, t int, y double", "memory array<double>", "append", "NoTimeout")
