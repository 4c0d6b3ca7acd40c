"""Structured Streaming over camera frames (frame_id, camera_id, ts timestamp, engine, serial, matched)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import datetime
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from serialspark.functions import decode as M
from serialspark.functions import text as X
from serialspark.operators import detections as D


def first_frames(frames: DataFrame, interval: str = "1 second", late: str = "1 minute") -> DataFrame:
    """The earliest frame of each camera and interval."""
    w = F.window("ts", interval)
    out = frames.withWatermark("ts", late).groupBy("camera_id", w).agg(F.min(F.struct("ts", "frame_id")).alias("first"))
    return out.select("camera_id", F.col("window.start").alias("start"), F.col("first.frame_id").alias("frame_id"))


def distinct_serials(frames: DataFrame, interval: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Each serial's first matched frame in each interval; a window's state is freed when the watermark has passed it."""
    w = F.window("ts", interval)
    out = frames.where("matched").withWatermark("ts", late).groupBy("serial", w).agg(F.min(F.struct("ts", "frame_id")).alias("first"))
    return out.select("serial", F.col("window.start").alias("start"), F.col("first.frame_id").alias("frame_id"))


def recognitions(frames: DataFrame, classes: int = 13, least: float = 0.5) -> DataFrame:
    """Frames with logits as frames with serial, confidence and matched: decoded, corrected and gated by confidence, without state."""
    read = M.with_reading(frames, F.col("logits"), F.lit(classes)).withColumn("c", X.corrected(X.normalized(F.col("d.text"))))
    ok = F.col("c").isNotNull() & (F.col("d.confidence") >= least)
    return read.withColumns({"serial": F.col("c.text"), "confidence": F.col("d.confidence"), "matched": F.coalesce(ok, F.lit(False))}).drop("d", "c", "logits")


def engine_counts(frames: DataFrame, interval: str = "1 hour", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Frames and matched ones of each engine and window; with slide, windows overlap. Rows of windows that the watermark has passed are dropped."""
    w = F.window("ts", interval, slide) if slide else F.window("ts", interval)
    return frames.withWatermark("ts", late).groupBy("engine", w).agg(F.count("*").alias("n"), F.count_if("matched").alias("n_matched")).select("engine", F.col("window.start").alias("start"), "n", "n_matched")


SIGHTING = "serial string, ts timestamp, frame_id long"


def merged(start: np.ndarray, end: np.ndarray, frame: np.ndarray, gap: int) -> tuple[np.ndarray, ...]:
    """Intervals (start, end, frame at the start) with those joined that are at most gap apart."""
    order = np.lexsort((frame, start))
    start, end, frame = start[order], np.maximum.accumulate(end[order]), frame[order]
    first = np.flatnonzero(np.r_[True, start[1:] - end[:-1] > gap]) if len(start) else np.zeros(0, int)
    return start[first], np.maximum.reduceat(end, first) if len(first) else end, frame[first]


def sightings(frames: DataFrame, gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Each serial's first matched frame of a sighting, at once; it counts again only after a gap in which it isn't seen.

    A sighting goes on as long as matched frames are at most the gap apart, whatever full hours lie between. State is a serial's
    open sightings as intervals, so a serial of any number of rows takes as much as one; they go when the watermark has passed
    their end by the gap. A row older than an open sighting, but within the gap, belongs to it and puts out nothing.
    """
    gap_us = int(pd.Timedelta(gap).total_seconds() * 1_000_000)

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_start, open_end = (np.array(x, np.int64) for x in state.get) if state.exists else (np.zeros(0, np.int64),) * 2
        start = end = frame = np.zeros(0, np.int64)
        if not state.hasTimedOut:
            for pdf in batches:
                ts = pdf["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
                start, end, frame = merged(np.r_[start, ts], np.r_[end, ts], np.r_[frame, pdf["frame_id"].to_numpy(np.int64)], gap_us)
        # a sighting is new if its interval reaches no open one
        known = ((start[:, None] <= open_end + gap_us) & (end[:, None] >= open_start - gap_us)).any(axis=1) if len(start) else np.zeros(0, bool)
        all_start, all_end, _ = merged(np.r_[open_start, start], np.r_[open_end, end], np.zeros(len(open_start) + len(start), np.int64), gap_us)
        alive = all_end + gap_us >= state.getCurrentWatermarkMs() * 1000
        if alive.any():
            state.update((all_start[alive].tolist(), all_end[alive].tolist()))
            state.setTimeoutTimestamp(max(int((all_end[alive].max() + gap_us) // 1000) + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if not known.all():
            yield pd.DataFrame({"serial": [key[0]] * int((~known).sum()), "ts": start[~known].astype("datetime64[us]"), "frame_id": frame[~known]})

    rows = frames.where("matched and serial is not null").select("serial", "ts", "frame_id").withWatermark("ts", late)
    return rows.groupBy("serial").applyInPandasWithState(follow, SIGHTING, "starts array<long>, ends array<long>", "append", GroupStateTimeout.EventTimeTimeout)


class Run(NamedTuple):
    """What a finished run of a stream left: its rows so far, its watermark, and rows dropped, in state now and in state at most."""

    rows: DataFrame
    watermark: datetime | None
    dropped: int
    state_rows: int
    most_state_rows: int


def run(spark: SparkSession, stream: DataFrame, at: str) -> Run:
    """Runs a stream over all that is there and not yet taken, into the table of the folder at; late rows beyond the watermark are dropped and counted."""
    query = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/out")
    query.awaitTermination()
    progress = [p for p in query.recentProgress if p.stateOperators]
    state = [sum(o.numRowsTotal for o in p.stateOperators) for p in progress]
    text = next((p.eventTime["watermark"] for p in reversed(progress) if "watermark" in p.eventTime), None)
    watermark = datetime.fromisoformat(text) if text else None
    dropped = sum(o.numRowsDroppedByWatermark for p in progress for o in p.stateOperators)
    return Run(spark.read.schema(stream.schema).parquet(f"{at}/out"), watermark, dropped, state[-1] if state else 0, max(state, default=0))


def whole(closed: Run, stored: DataFrame, aggregate: Callable[[DataFrame], DataFrame], interval: str) -> DataFrame:
    """A finished stream's windows and those that its watermark hasn't passed, from the stored rows that can lie in one of these."""
    if closed.watermark is None:
        return aggregate(stored)
    mark, length = F.lit(closed.watermark).cast("timestamp"), F.expr(f"interval {interval}")
    still_open = aggregate(stored.where(F.col("ts") >= mark - length)).where(F.col("start") + length > mark)
    return closed.rows.unionByName(still_open)


def suppress_into(stream: DataFrame, path: str, checkpoint: str, threshold: float = 0.3, keys: Sequence[str] = ("image_id", "text"), fail_at: int | None = None) -> None:
    """Suppresses a stream of scored boxes by text inside each frame and writes what stays to a folder for each batch under path.

    A frame's boxes must come in one batch, as those of a file do. A batch that runs again after a failure writes its folder
    anew, so it adds nothing. fail_at: for tests, a batch that fails once its rows are written.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        D.nms_by_text(batch, threshold, keys).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        if batch_id == fail_at:
            raise RuntimeError(f"batch {batch_id} fails")

    stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def suppressed(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """What suppress_into has written."""
    return spark.read.schema(like.schema).option("basePath", path).parquet(path).select(*like.columns)
