"""Whole jobs from image files: plates with serials are cut into windows, scored, read, ranked and diagnosed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from serialspark import schemas as C
from serialspark.functions import decode as M
from serialspark.operators import detections as D
from serialspark.operators import evaluation as V
from serialspark.operators import pixels as P
from serialspark.plans.fixtures import spark_sql
from serialspark.plans.q_boxes import duck_inside, duck_iou
from serialspark.plans.q_jobs import _images
from serialspark.plans.registry import query
from serialspark.sources import files as S
from serialspark.sources.store import place as _place

#: A strip of 80 x 8 pixels for each customer, four of which make an image; neighbours may show the same serial.
STRIPS = """select c_custkey as gt_id, cast(floor(c_custkey / 4) as bigint) as image_id, cast(c_custkey % 4 as int) as strip, cast(8 * (c_custkey % 3) as int) as x0,
  case when c_custkey % 5 = 0 then 'negative' else 'positive' end as category,
  concat(case when c_custkey % 6 = 0 then 'E103MM' else 'E300MM' end, lpad(cast(cast(floor(c_custkey / 2) as bigint) * 7 % 1000000 as varchar(20)), 6, '0')) as s from {customer}"""
#: A character shows as four columns of its own brightness, with noise; v is blue and green, red is more on every other strip.
PIXELS = f"""select image_id, gt_id, strip * 8 + y as y, x, cast(case when x < x0 or x >= x0 + 64 then 12 + (x * 3 + y * 5 + gt_id) % 7
    else 12 + 19 * (case when floor((x - x0) / 4) > 11 then 12 else instr('0123456789EM', substr(s, cast(floor((x - x0) / 4) as int) + 1, 1)) - 1 end) + (x * 5 + y * 3 + gt_id) % 9 - 4 end as int) as v
  from ({STRIPS})"""
DUCK_PIXELS = f"(select *, v + 0.2126 * 10 * (gt_id % 2) as g from ({PIXELS}, range(0, 8) a(y), range(0, 80) b(x)))"
SIZE, STRIDE, CELL = (64, 8), (8, 4), (64, 8)


def _strip_bytes(gt_id: np.ndarray, x0: np.ndarray, serials: list[str]) -> np.ndarray:
    """PIXELS of strips as (n, 8, 80, 3) bytes in blue, green, red."""
    x, y, gt_id = np.arange(80)[None, None], np.arange(8)[None, :, None], gt_id[:, None, None]
    classes = np.full((len(serials), 16), 12)
    classes[:, :12] = np.array([["0123456789EM".index(c) for c in s] for s in serials]).reshape(-1, 12)
    at = x[0] - x0[:, None]
    inside = ((at >= 0) & (at < 64))[:, None]
    shown = 12 + 19 * np.take_along_axis(classes, at.clip(0, 63) // 4, axis=1)[:, None] + (x * 5 + y * 3 + gt_id) % 9 - 4
    v = np.where(inside, shown, 12 + (x * 3 + y * 5 + gt_id) % 7)
    return np.stack([v, v, v + 10 * (gt_id % 2)], axis=-1).astype(np.uint8)


def _plates(spark, sf):
    """The image files, stored as rows of a path and its content and read again."""

    def paint(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), 1000):
                own = pdf.iloc[lo : lo + 1000]
                pixels = _strip_bytes(own["gt_id"].to_numpy(), own["x0"].to_numpy(), own["s"].tolist())
                yield own[["image_id", "strip"]].assign(data=[p.tobytes() for p in pixels])

    strips = spark_sql(spark, sf, STRIPS).select("image_id", "strip", "gt_id", "x0", "s").mapInPandas(paint, "image_id long, strip int, data binary")
    own = F.sort_array(F.collect_list(F.struct("strip", "data")))
    rows = strips.groupBy("image_id").agg((8 * (F.max("strip") + 1)).cast("int").alias("height"), F.aggregate(own, F.lit(b""), lambda a, s: F.concat(a, s["data"])).alias("data"))
    folder = _place(spark, "plates")
    S.bmp_files(rows.select("image_id", F.lit(80).alias("width"), "height", "data"), "plates").write.parquet(folder)
    return _images(spark.read.parquet(folder))


def _templates():
    """A scorer with fixed weights: how far each step's brightness, in whole grey values, is from each class's."""
    wanted = 12 + 19 * np.arange(13)

    def scores(batch: np.ndarray) -> np.ndarray:
        n, height, width = batch.shape
        steps = batch.reshape(n, height, 16, width // 16).mean(axis=(1, 3), dtype=np.float64)
        level = np.floor(127.5 * (steps + 1) + 0.3)
        return -((level[:, :, None] - wanted) ** 2) / 64

    return scores


#: The same scores in SQL, of windows w (image_id, x1, y1): a row for each step, with its best class.
CELLS = f"select image_id, y, (x // 4)::int as c, sum(g) as g from {DUCK_PIXELS} group by 1, 2, 3"
WINDOWS = "select image_id, x1, y1, x1 + 64 as x2, y1 + 8 as y2, height from (select image_id, max(y) + 1 as height from {pixels} group by 1) i, (values (0), (8), (16)) a(x1), range(0, 25, 4) b(y1) where y1 + 8 <= height".replace("{pixels}", DUCK_PIXELS)
READ = f"""select image_id, x1, y1, coalesce(string_agg('0123456789EM'[ix + 1], '' order by t) filter (ix <> 12), '') as text, round(least(exp(avg(ln(greatest(top1, 1e-9)))), min(top1)), 6) as conf from (
    select *, list_position(r, list_max(r)) - 1 as ix, 1 / list_sum(list_transform(r, lambda v: exp(v - list_max(r)))) as top1 from (
      select image_id, x1, y1, t, list_transform(range(0, 13), lambda k: -power(floor(level + 0.3) - 12 - 19 * k, 2) / 64::double) as r from (
        select w.image_id, w.x1, w.y1, c.c - w.x1 // 4 as t, sum(c.g) / 32 as level from ({WINDOWS}) w join ({CELLS}) c on c.image_id = w.image_id and c.y >= w.y1 and c.y < w.y1 + 8 and c.c >= w.x1 // 4 and c.c < w.x1 // 4 + 16 group by 1, 2, 3, 4)))
  group by 1, 2, 3"""


@query(f"""with recursive f as (select image_id, (y1 // 4 * 10 + x1 // 8)::bigint as det_id, regexp_extract(text, '{C.SERIAL_PARTIAL}') as text, case when regexp_matches(text, '{C.SERIAL_STRICT}') then 1 else 5 end as stage, conf, x1::int as x1, y1::int as y1, (x1 + 64)::int as x2, (y1 + 8)::int as y2
  from ({READ}) where regexp_matches(text, '{C.SERIAL_PARTIAL}') and conf >= 0.5),
o as (select *, row_number() over (partition by image_id, text order by conf desc, det_id) as k from f),
walk as (select image_id, text, k, [struct_pack(det_id := det_id, x1 := x1, y1 := y1, x2 := x2, y2 := y2)] as kept from o where k = 1
  union all select w.image_id, w.text, o.k, case when len(list_filter(w.kept, lambda q: {duck_iou('q.', 'o.')} >= 0.3)) > 0 then w.kept else list_append(w.kept, struct_pack(det_id := o.det_id, x1 := o.x1, y1 := o.y1, x2 := o.x2, y2 := o.y2)) end
  from walk w join o on o.image_id = w.image_id and o.text = w.text and o.k = w.k + 1),
last as (select image_id, kept, row_number() over (partition by image_id, text order by k desc) as r from walk),
ids as (select image_id, unnest(kept).det_id as det_id from last where r = 1)
select image_id, det_id, text, stage, floor(conf * 10000 + 0.5) / 10000 as conf, x1, y1, x2, y2, row_number() over (partition by image_id order by conf desc, det_id)::int as rank from f semi join ids using (image_id, det_id)""")
def image_to_reading(spark, sf):
    """From image files to ranked readings: windows, tensors, scores, decoding, correction, gate, suppression, ranks."""
    images = _plates(spark, sf)
    windows = D.sliding_windows(images.select("image_id", "width", "height"), SIZE, STRIDE)
    scored = P.logits(P.crop_tensors(images, windows, *CELL), _templates, CELL[::-1])
    read = M.with_reading(scored.drop("tensor"), F.col("logits"), F.lit(13))
    det_id = (F.expr("y1 div 4 * 10 + x1 div 8")).cast("long")
    return D.recognized(read.select("image_id", det_id.alias("det_id"), "d.text", F.round("d.confidence", 6).alias("conf"), "x1", "y1", "x2", "y2"), F.col("text"))


def _reader():
    """The scorer and its decoding as one function from tensors of 32 x 128 to texts and confidences."""
    scores = _templates()

    def read(batch: np.ndarray) -> tuple[list[str], np.ndarray]:
        texts, confidences = M.read_steps(scores(batch))
        return texts, np.round(confidences, 6)

    return read


EDGE, VARIANCE = 195.0, 4300.0


def _diagnosed(spark, sf):
    truth = spark_sql(spark, sf, STRIPS).selectExpr("image_id", "gt_id", "category", "x0 as x1", "strip * 8 as y1", "x0 + 64 as x2", "strip * 8 + 8 as y2")
    return P.diagnose(_plates(spark, sf), truth, _reader, C.TRUTH_STRICT, SIZE, STRIDE, edge=EDGE, variance=VARIANCE)


FRAME = "rows between 3 preceding and 3 following"
DIAGNOSED = f"""with px as (select image_id, x, y, g::double as g from {DUCK_PIXELS}),
n as (select *, lag(g) over r as l, lead(g) over r as e, lag(g) over c as u, lead(g) over c as d, sum(g) over (r {FRAME}) as s1, sum(g * g) over (r {FRAME}) as s2, count(*) over (r {FRAME}) as n1
  from px window r as (partition by image_id, y order by x), c as (partition by image_id, x order by y)),
h as (select *, lag(u) over r as ul, lead(u) over r as ue, lag(d) over r as dl, lead(d) over r as de, sum(s1) over (c {FRAME}) as a1, sum(s2) over (c {FRAME}) as a2, sum(n1) over (c {FRAME}) as a0
  from n window r as (partition by image_id, y order by x), c as (partition by image_id, x order by y)),
b as (select image_id, x // 8 as bx, y // 4 as bv, sum(coalesce(sqrt(power((ue + 2 * e + de) - (ul + 2 * l + dl), 2) + power((dl + 2 * d + de) - (ul + 2 * u + ue), 2)), 0)) as edge, sum(greatest(a2 / a0 - (a1 / a0) * (a1 / a0), 0)) as var from h group by 1, 2, 3),
f as (select w.image_id, w.x1, w.y1, w.x2, w.y2, sum(edge) / 512 as edge, sum(var) / 512 as var from ({WINDOWS}) w join b on b.image_id = w.image_id and bx >= w.x1 // 8 and bx < w.x1 // 8 + 8 and bv >= w.y1 // 4 and bv < w.y1 // 4 + 2 group by all),
gt as (select *, x0 as x1, strip * 8 as y1, x0 + 64 as x2, strip * 8 + 8 as y2 from ({STRIPS})),
k as (select f.image_id, f.x1, f.y1, max(case when category = 'positive' then {duck_iou('f.', 'g.')} else 0 end) as p, max(case when category = 'negative' then {duck_iou('f.', 'g.')} else 0 end) as n from f join gt g on f.image_id = g.image_id group by all),
w as (select f.*, case when p >= 0.3 and p >= n then 'pos' when n >= 0.3 then 'neg' else 'undef' end as class, f.edge >= {EDGE} and f.var >= {VARIANCE} as passed, r.text as raw, r.conf as raw_conf from f join k using (image_id, x1, y1) join ({READ}) r using (image_id, x1, y1)),
v as (select *, case when passed then raw else '' end as text, case when passed then raw_conf else 0 end as conf, passed and regexp_matches(raw, '{C.TRUTH_STRICT}') as matched from w)"""


def _spread(c: str) -> str:
    names = (("min", f"min({c})"), ("p25", f"quantile_cont({c}, 0.25)"), ("p50", f"quantile_cont({c}, 0.5)"), ("p75", f"quantile_cont({c}, 0.75)"), ("max", f"max({c})"), ("mean", f"avg({c})"))
    return ", ".join(f"round({f}, 4) as {c}_{n}" for n, f in names)


@query(f"""{DIAGNOSED} select image_id, class, count(*) as n, count(*) filter (passed) as n_passed, count(*) filter (matched) as n_matched, count(*) filter (matched and conf >= 0.5) as n_high, count(*) filter (text <> '') as n_nonempty, round(sum(conf), 4) as conf_sum,
  {_spread('edge')}, {_spread('var')} from v group by image_id, class""")
def diagnose_images(spark, sf):
    """From image files: counts of windows and the spread of their features, for each image and class."""
    rows = _diagnosed(spark, sf).select("image_id", F.explode("classes").alias("c")).select("image_id", "c.*").where("n > 0")
    spread = [F.round(F.col(k)[m], 4).alias(f"{k}_{m}") for k in ("edge", "var") for m in P.SUMMARY[1:]]
    return rows.select("image_id", "class", "n", "n_passed", "n_matched", "n_high", "n_nonempty", F.round("conf_sum", 4).alias("conf_sum"), *spread)


@query(f"""{DIAGNOSED}, best as (select class, image_id, text, conf, x1::int as x1, y1::int as y1, row_number() over (partition by class order by conf desc, image_id, x1, y1)::int as rank from v where matched)
select class, rank, image_id, text, conf, x1, y1 from best where rank <= 5""")
def diagnose_samples(spark, sf):
    return P.class_samples(_diagnosed(spark, sf))


@query(f"""{DIAGNOSED}, j as (select g.image_id, g.gt_id, {duck_iou('g.', 'v.')} as iou, {duck_inside('g.', 'v.')} as inside, matched, conf from gt g join v on v.image_id = g.image_id where category = 'positive'),
z as (select image_id, gt_id, max(iou) as iou, max(inside) as inside, bool_or(iou >= 0.3 and matched and conf >= 0.5) as ok from j group by 1, 2)
select image_id, count(*) as n, round(avg((iou >= 0.3)::int::double), 6) as covered_3, round(avg((iou >= 0.5)::int::double), 6) as covered_5, round(avg((iou >= 0.7)::int::double), 6) as covered_7, round(avg((inside >= 0.9)::int::double), 6) as contained_9, round(avg(ok::int::double), 6) as recognised,
  round(avg(iou), 6) as mean_iou, round(avg(inside), 6) as mean_containment from z group by grouping sets ((image_id), ())""")
def diagnose_coverage(spark, sf):
    return V.rounded(D.coverage_summary(P.truth_coverage(_diagnosed(spark, sf)), "image_id"))
