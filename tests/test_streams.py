"""Streams in several runs: sightings, late rows, bounded state, repeated batches."""

import pytest
from pyspark.sql import functions as F

from serialspark.operators import detections as D
from serialspark.streaming import frames as W

FRAMES = "frame_id long, camera_id long, ts timestamp, engine string, serial string, matched boolean"


def at(minute, serial="s", frame_id=None, matched=True):
    return f"select {minute if frame_id is None else frame_id}L as frame_id, 1L as camera_id, timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, {minute}) as ts, 'e' as engine, {'null' if serial is None else repr(serial)} as serial, {str(matched).lower()} as matched"


def stream_in_parts(spark, folder, make, parts):
    """Runs a stream once for each part of rows, and returns the runs."""
    runs = []
    for rows in parts:
        df = spark.sql(" union all ".join(rows)) if rows else spark.createDataFrame([], FRAMES)
        df.write.mode("append").parquet(f"{folder}/in")
        runs.append(W.run(spark, make(spark.readStream.schema(df.schema).parquet(f"{folder}/in")), folder))
    return runs


def test_a_sighting_goes_on_over_full_hours(spark, tmp_path):
    parts = [[at(50), at(55), at(65), at(10, "t"), at(58, None), at(57, "u", matched=False)], [at(110), at(45, frame_id=999), at(100, "t")], [at(400, "z")], [at(401), at(500, "t")]]
    runs = stream_in_parts(spark, tmp_path, W.sightings, parts)
    found = sorted((r.serial, r.frame_id) for r in runs[-1].rows.collect())
    # 65 -> 110 is no gap; 45 is older, but of the same sighting; t is seen again after 90 minutes
    assert found == [("s", 50), ("s", 401), ("t", 10), ("t", 100), ("t", 500), ("z", 400)]


def test_state_of_sightings_is_bounded(spark, tmp_path):
    parts = [[at(600 * p + i, f"p{p}_{i}") for i in range(20)] for p in range(5)]
    runs = stream_in_parts(spark, tmp_path, W.sightings, parts)
    assert runs[-1].rows.count() == 100 and max(r.most_state_rows for r in runs) <= 40 and runs[-1].state_rows <= 20


def test_repeated_rows_of_one_serial_take_one_interval(spark, tmp_path):
    [run] = stream_in_parts(spark, tmp_path, W.sightings, [[f"select id as frame_id, 1L as camera_id, timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id % 977) as ts, 'e' as engine, 's' as serial, true as matched from range(50000)"]])
    assert [r.frame_id for r in run.rows.collect()] == [0] and run.state_rows == 1


@pytest.mark.parametrize("slide", [None, "15 minutes"])
def test_late_rows_are_dropped_and_counted(spark, tmp_path, slide):
    count = lambda df: W.engine_counts(df, slide=slide)
    first, second = stream_in_parts(spark, tmp_path, count, [[at(5), at(20), at(300)], [at(10), at(250), at(310)]])
    assert first.dropped == 0 and second.dropped == (4 if slide else 1)
    stored = spark.read.parquet(f"{tmp_path}/in")
    whole = {str(r.start)[11:16]: r.n for r in W.whole(second, stored, count, "1 hour").collect()}
    if slide is None:
        assert whole == {"00:00": 2, "04:00": 1, "05:00": 2}
    else:
        assert whole == {"23:15": 1, "23:30": 2, "23:45": 2, "00:00": 2, "00:15": 1, "03:15": 1, "03:30": 1, "03:45": 1, "04:00": 1, "04:15": 2, "04:30": 2, "04:45": 2, "05:00": 2}
    assert second.state_rows < len(whole)


def test_a_batch_that_fails_after_its_write_adds_nothing(spark, tmp_path):
    boxes = spark.range(200).select((F.col("id") % 5).alias("image_id"), F.col("id").alias("det_id"), F.lit("t").alias("text"), (F.col("id") * 37 % 101 / 101).alias("conf"), *[(F.col("id") * k % 90 + add).cast("int").alias(c) for c, k, add in (("x1", 7, 0), ("y1", 11, 0), ("x2", 7, 60), ("y2", 11, 40))])
    args = f"{tmp_path}/out", f"{tmp_path}/state"
    stream = lambda: spark.readStream.schema(boxes.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for part in (0, 1):
        boxes.where(F.col("image_id") % 2 == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    with pytest.raises(Exception, match="batch 1 fails"):
        W.suppress_into(stream(), *args, fail_at=1)
    assert W.suppressed(spark, args[0], boxes).count() == D.nms_by_text(boxes).count()  # both batches are written, one not committed
    W.suppress_into(stream(), *args)
    W.suppress_into(stream(), *args)
    kept = sorted(r.det_id for r in W.suppressed(spark, args[0], boxes).collect())
    assert kept == sorted(r.det_id for r in D.nms_by_text(boxes).collect())
