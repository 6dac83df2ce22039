"""Event-time windows over batch or streaming DataFrames: tumbling, sliding and session, with watermarks for late events.

The same function serves ``spark.read`` and ``spark.readStream``; on a stream the watermark bounds the state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FUNCTIONS: dict[str, Callable[[str], Column]] = {"count": lambda c: F.count("*"), "sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "stddev": F.stddev_pop, "percentile": lambda c: F.percentile_approx(c, 0.95)}


def _instant(df: DataFrame, time: str) -> DataFrame:
    """Windows and watermarks need a timestamp with a zone."""
    return df.withColumn(time, F.col(time).cast("timestamp")) if isinstance(df.schema[time].dataType, T.TimestampNTZType) else df


def aggregated(df: DataFrame, time: str, window: Column, value: str, functions: list[str], keys: list[str], late: str | None) -> DataFrame:
    df = df.withWatermark(time, late) if late else df
    figures = [FUNCTIONS[f](value).alias(f) for f in functions] + [F.min(time).alias("first_event"), F.max(time).alias("last_event")]
    out = df.groupBy(window.alias("_w"), *keys).agg(*figures)
    return out.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *keys, *functions, "first_event", "last_event")


def tumbling(df: DataFrame, time: str, duration: str, value: str, functions=("count", "sum", "mean"), keys=(), late: str | None = None) -> DataFrame:
    df = _instant(df, time)
    return aggregated(df, time, F.window(time, duration), value, list(functions), list(keys), late)


def sliding(df: DataFrame, time: str, duration: str, slide: str, value: str, functions=("count", "sum", "mean"), keys=(), late: str | None = None) -> DataFrame:
    df = _instant(df, time)
    return aggregated(df, time, F.window(time, duration, slide), value, list(functions), list(keys), late)


def session(df: DataFrame, time: str, gap: str, value: str, functions=("count", "sum", "mean"), keys=(), late: str | None = None) -> DataFrame:
    df = _instant(df, time)
    return aggregated(df, time, F.session_window(time, gap), value, list(functions), list(keys), late)


class Processor:
    """A named chain of filter, map, flat_map and key_by over a DataFrame, streaming or not."""

    def __init__(self, name: str) -> None:
        self.name, self._steps = name, []

    def _add(self, step: Callable[[DataFrame], DataFrame]) -> Processor:
        self._steps.append(step)
        return self

    def filter(self, condition: str | Column) -> Processor:
        return self._add(lambda df: df.where(condition))

    def map(self, columns: dict[str, Column]) -> Processor:
        return self._add(lambda df: df.withColumns(columns))

    def flat_map(self, array: Column, name: str) -> Processor:
        return self._add(lambda df: df.withColumn(name, F.explode(array)))

    def key_by(self, key: Column) -> Processor:
        return self._add(lambda df: df.withColumn("key", key))

    def __call__(self, df: DataFrame) -> DataFrame:
        for step in self._steps:
            df = step(df)
        return df


def run_to_memory(df: DataFrame, name: str, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """Drive a stream over what its source holds now, into an in-memory table."""
    writer = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def run_to_parquet(df: DataFrame, path: str, checkpoint: str) -> None:
    """Append finished windows; with the checkpoint each is written once."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def from_folder(spark: SparkSession, path: str, schema: T.StructType | None = None, files_per_batch: int | None = None) -> DataFrame:
    """A stream over the Parquet files of a folder."""
    reader = spark.readStream.schema(schema or spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def running_totals(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keyed state across batches: count, sum, and first and last batch's value of each key, updated as events come."""
    kind = df.schema[key].dataType.simpleString()
    out = f"{key} {kind}, count long, sum double, last double"

    def update(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total, last = state.get if state.exists else (0, 0.0, 0.0)
        for p in parts:
            if len(p):
                n, total, last = n + len(p), total + float(p[value].sum()), float(p[value].iloc[-1])
        state.update((n, total, last))
        yield pd.DataFrame({key: [k[0]], "count": [n], "sum": [total], "last": [last]})

    return df.groupBy(key).applyInPandasWithState(update, out, "count long, sum double, last double", "update", "NoTimeout")


def metrics(query) -> dict:
    """Rows and rates of a running query's last batch."""
    p = query.lastProgress or {}
    return {k: p.get(k) for k in ("batchId", "numInputRows", "inputRowsPerSecond", "processedRowsPerSecond")}
