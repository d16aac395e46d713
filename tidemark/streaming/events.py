"""Structured Streaming over dated events: windows, sessions, first-seen elements and an online changepoint filter."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tidemark.operators import kernels


def stream_files(spark: SparkSession, folder: str, schema: StructType | str, files: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder, so many at a time; progress lives in the query's checkpoint."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def stamped(events: DataFrame, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """ts as a zoned timestamp (watermarks reject the unzoned kind) with a watermark for late events."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def windowed(events: DataFrame, size: str, slide: str | None = None, keys: tuple[str, ...] = ("event_type",), ts: str = "ts", value: str = "value") -> DataFrame:
    """Count, sum and greatest value of tumbling (no slide) or sliding windows."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = events.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.max(value).alias("peak"))
    return out.select(F.col("w.start").alias("starts"), F.col("w.end").alias("ends"), *keys, "n", "total", "peak")


def sessions(events: DataFrame, gap: str | Column = "30 minutes", keys: tuple[str, ...] = ("user_id",), ts: str = "ts") -> DataFrame:
    """Sessions that end after a gap without events."""
    out = events.groupBy(F.session_window(ts, gap).alias("s"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("s.start").alias("starts"), F.col("s.end").alias("ends"), *keys, "n")


def first_seen(events: DataFrame, keys: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Each key once within the watermark: the stream of new elements."""
    return events.dropDuplicatesWithinWatermark(list(keys))


def changepoints(counts: DataFrame, key: str = "lineage_id", hazard: float = 1 / 50, window: int = 3, longest: int = 40) -> DataFrame:
    """(key, q_idx, changepoint_prob, late) of a stream of quarterly counts (key, q_idx, new_works).

    State for a key is the filter's own: mass, shape and rate of at most `longest` + 1 run lengths, and the last quarter. Quarters
    of a batch are taken in order, one step each. A quarter that comes after a later one was taken can't be filtered any more: it
    gives a row with late true and no probability.
    """

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, mass, shape, rate = state.get if state.exists else (None, [1.0], [1.0], [0.1])
        held = kernels.RunLengths(*(np.array(v, dtype=float) for v in (mass, shape, rate)))
        rows = pd.concat(list(batches)).sort_values("q_idx")
        out: list[tuple[Any, int, float | None, bool]] = []
        for q, x in zip(rows["q_idx"], rows["new_works"], strict=True):
            if last is not None and q <= last:
                out.append((name[0], int(q), None, True))
                continue
            held, last = held.step(float(x), hazard, longest), int(q)
            out.append((name[0], last, float(held.mass[: window + 1].sum()), False))
        state.update((last, held.mass.tolist(), held.shape.tolist(), held.rate.tolist()))
        yield pd.DataFrame(out, columns=[key, "q_idx", "changepoint_prob", "late"])

    kind = counts.schema[key].dataType.simpleString()
    held = "last int, mass array<double>, shape array<double>, rate array<double>"
    return counts.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, q_idx int, changepoint_prob double, late boolean", held, "append", GroupStateTimeout.NoTimeout)
