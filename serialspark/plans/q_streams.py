"""Streaming queries over the events table, run once over all that is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from serialspark.plans import q_boxes  # noqa: F401
from serialspark.plans.fixtures import fx
from serialspark.plans.registry import ORACLES, query
from serialspark.sources.store import place
from serialspark.streaming import frames as W


def _events(spark, sf, stored: bool):
    table = spark.read.parquet(f"{sf}/events.parquet")
    return table if stored else spark.readStream.schema(table.schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def _whole(spark, sf, frames, aggregate, interval: str):
    """An aggregate's windows: the stream's, and those still open at its end."""
    closed = W.run(spark, aggregate(frames(spark, sf)), place(spark, "stream"))
    return W.whole(closed, frames(spark, sf, True), aggregate, interval).withColumn("start", F.col("start").cast("timestamp_ntz"))


def _frames(spark, sf, stored: bool = False):
    return _framed(_events(spark, sf, stored))


def _framed(events):
    serial = F.concat(F.lit("E300MM"), F.lpad((F.col("user_id") * 7 % 1000).cast("string"), 6, "0"))
    engine = F.when(F.col("event_id") % 3 == 0, "engine_a").otherwise("engine_b")
    return events.select(F.col("event_id").alias("frame_id"), (F.col("user_id") % 10).alias("camera_id"), F.col("ts").cast("timestamp").alias("ts"), engine.alias("engine"), serial.alias("serial"), (F.col("value") > 10).alias("matched"))


@query("""select camera_id, start, arg_min(frame_id, (ts, frame_id)) as frame_id from (select *, date_trunc('second', ts) as start from {fx_frames}) group by 1, 2""")
def stream_frame_sample(spark, sf):
    return _whole(spark, sf, _frames, W.first_frames, "1 second")


@query("""select engine, start, count(*) as n, count(*) filter (matched) as n_matched from (select *, date_trunc('hour', ts) as start from {fx_frames}) group by 1, 2""")
def stream_engine_counts(spark, sf):
    return _whole(spark, sf, _frames, W.engine_counts, "1 hour")


@query("""select serial, date_trunc('hour', ts) as start, arg_min(frame_id, (ts, frame_id)) as frame_id from {fx_frames} where matched group by 1, 2""")
def stream_serial_dedupe(spark, sf):
    return _whole(spark, sf, _frames, W.distinct_serials, "1 hour")


@query("""select serial, ts, frame_id from (select serial, ts, frame_id, ts - lag(ts) over (partition by serial order by ts, frame_id) as since from {fx_frames} where matched) where since is null or since > interval 1 hour""")
def stream_sightings(spark, sf):
    """One row for each sighting of a serial, across full hours."""
    found = W.run(spark, W.sightings(_frames(spark, sf)), place(spark, "stream")).rows
    return found.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


#: Every tenth event comes late, in a second part of the stream.
LATE = "event_id % 10 = 0"
SLIDING = """with f as (select *, frame_id % 10 = 0 as late from {fx_frames}), m as (select date_trunc('millisecond', max(ts)) - interval 1 hour as mark from f where not late),
w as (select engine, matched, late, time_bucket(interval 15 minute, ts) - k * interval 15 minute as start from f, range(0, 4) r(k))"""


@query(f"""{SLIDING} select engine, start, count(*) as n, count(*) filter (matched) as n_matched from w, m where not late or start + interval 1 hour > mark group by 1, 2""")
def stream_sliding_counts(spark, sf):
    """Windows of an hour that begin every quarter; rows that come after the watermark has passed their window are left out."""
    events, at = _events(spark, sf, True), place(spark, "stream")
    count = lambda df: W.engine_counts(df, "1 hour", "1 hour", "15 minutes")
    for part in (f"not ({LATE})", LATE):
        events.where(part).write.mode("append").parquet(f"{at}/in")
        done = W.run(spark, count(_framed(spark.readStream.schema(events.schema).parquet(f"{at}/in"))), at)
    return W.whole(done, _frames(spark, sf, True), count, "1 hour").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(ORACLES["nms_by_text"])
def stream_suppression(spark, sf):
    """Boxes suppressed inside each frame as they come, in a sink that a repeated batch can't add to."""
    boxes, at = fx(spark, sf, "fx_detections"), place(spark, "stream")
    boxes.write.parquet(f"{at}/in")
    W.suppress_into(spark.readStream.schema(boxes.schema).parquet(f"{at}/in"), f"{at}/out", f"{at}/state")
    return W.suppressed(spark, f"{at}/out", boxes)


#: The scores of a 16-step head that reads a serial of the user, with gaps that depend on the event.
SCORES = """transform(sequence(0, 207), i -> case when i % 13 = case when floor(i / 13) > 11 then 12 else instr('0123456789EM', substr(s, cast(floor(i / 13) as int) + 1, 1)) - 1 end
  then 1.0D + event_id % 5 else cast((event_id * 7 + i * 3) % 11 as double) / 8 end)"""


def _scored(spark, sf, stored: bool = False):
    events = _events(spark, sf, stored).withColumn("s", F.concat(F.when(F.col("event_id") % 4 == 0, "E103MM").otherwise("E300MM"), F.lpad((F.col("user_id") * 7 % 1000).cast("string"), 6, "0")))
    return W.recognitions(events.select(F.col("event_id").alias("frame_id"), F.col("ts").cast("timestamp").alias("ts"), F.expr(SCORES).alias("logits")))


@query("""with l as (select event_id, ts, s, list_transform(range(0, 16), lambda t: list_transform(range(0, 13), lambda c: case when c = case when t > 11 then 12 else instr('0123456789EM', s[t + 1]) - 1 end
    then 1.0::double + event_id % 5 else ((event_id * 7 + (t * 13 + c) * 3) % 11)::double / 8 end)) as steps
  from (select event_id, ts, concat(case when event_id % 4 = 0 then 'E103MM' else 'E300MM' end, lpad((user_id * 7 % 1000)::varchar, 6, '0')) as s from {events})),
p as (select event_id, ts, list_transform(steps, lambda r: list_position(r, list_max(r)) - 1) as ids, list_transform(steps, lambda r: 1 / list_sum(list_transform(r, lambda v: exp(v - list_max(r))))) as tops from l),
d as (select event_id, ts, array_to_string(list_transform(list_filter(ids, lambda i: i <> 12), lambda i: '0123456789EM'[i + 1]), '') as text, least(exp(list_avg(list_transform(tops, lambda q: ln(greatest(q, 1e-9))))), list_min(tops)) as conf from p),
c as (select *, coalesce(nullif(regexp_extract(text, 'E[39][0-9]{2}MM[0-9]{6}'), ''), null) as serial from d)
select serial, date_trunc('hour', ts) as start, arg_min(event_id, (ts, event_id)) as frame_id from c where serial is not null and conf >= 0.5 group by 1, 2""")
def stream_recognition(spark, sf):
    return _whole(spark, sf, _scored, W.distinct_serials, "1 hour")
