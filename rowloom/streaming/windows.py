"""Tumbling, sliding and session windows with watermarks, running aggregates a key, and a driver for finite inputs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed(events: DataFrame, time: str, length: str, aggregates: list[Column], keys: tuple[str, ...] = (), slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Aggregates of each window and key; events later than the watermark are left out when streamed."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    spans = F.window(time, length, slide) if slide else F.window(time, length)
    found = marked.groupBy(spans.alias("w"), *keys).agg(*aggregates)
    return found.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in found.columns if c != "w"])


def sessions(events: DataFrame, time: str, gap: str, aggregates: list[Column], keys: tuple[str, ...], late: str = "10 minutes") -> DataFrame:
    marked = events.withWatermark(time, late) if events.isStreaming else events
    found = marked.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*aggregates)
    return found.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in found.columns if c != "w"])


def running_average(events: DataFrame, key: str, time: str, value: str, decay: float) -> DataFrame:
    """EXPMOVAVG over a stream: a key's state is the last average; events of a batch are taken in time order."""

    def step(group, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        (s,) = state.get if state.exists else (None,)
        for pdf in [pd.concat(list(frames))]:
            pdf = pdf.sort_values("t")
            out = []
            for x in pdf["x"]:
                if not pd.isna(x):
                    s = float(x) if s is None else (1 - decay) * s + decay * float(x)
                out.append(s)
            if s is not None:
                state.update((s,))
            yield pd.DataFrame({"k": group[0], "t": pdf["t"], "average": out})

    narrow = events.select(F.col(key).alias("k"), F.col(time).cast("timestamp").alias("t"), F.col(value).cast("double").alias("x"))
    kind = dict(narrow.dtypes)["k"]
    return narrow.groupBy("k").applyInPandasWithState(step, f"k {kind}, t timestamp, average double", "s double", "append", "NoTimeout")


def run_to_end(spark: SparkSession, stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a streaming query over all that is there and gives its rows, which tasks write to a folder that all share; the last batch has them all."""
    folder = f"{_shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    write = lambda batch, _: batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{folder}/rows")
    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def _shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if configured := context.getConf().get("spark.checkpoint.dir"):
        return configured
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="rowloom-")
