"""Queries over boxes, windows, detections and pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from serialspark.functions import boxes as B
from serialspark.operators import detections as D
from serialspark.operators import pixels as P
from serialspark.plans.fixtures import fx, spark_sql
from serialspark.plans.registry import ORACLES, query


def duck_iou(a: str, b: str) -> str:
    inter = f"(greatest(least({a}x2, {b}x2) - greatest({a}x1, {b}x1), 0) * greatest(least({a}y2, {b}y2) - greatest({a}y1, {b}y1), 0))"
    return f"({inter}::double / (({a}x2 - {a}x1) * ({a}y2 - {a}y1) + ({b}x2 - {b}x1) * ({b}y2 - {b}y1) - {inter}))"


def duck_inside(a: str, b: str) -> str:
    return f"(greatest(least({a}x2, {b}x2) - greatest({a}x1, {b}x1), 0) * greatest(least({a}y2, {b}y2) - greatest({a}y1, {b}y1), 0))::double / (({a}x2 - {a}x1) * ({a}y2 - {a}y1))"


PAIRS = "select a.image_id, a.det_id, b.det_id as other_id, a.x1, a.y1, a.x2, a.y2, b.x1 as bx1, b.y1 as by1, b.x2 as bx2, b.y2 as by2 from {fx_detections} a join {fx_detections_b} b on a.image_id = b.image_id"


@query(f"select image_id, det_id, other_id, round({duck_iou('p.', 'p.b')}, 6) as iou from ({PAIRS}) p")
def box_iou(spark, sf):
    return spark_sql(spark, sf, PAIRS).select("image_id", "det_id", "other_id", F.round(B.iou(B.box(), B.box("b")), 6).alias("iou"))


@query(f"select image_id, det_id, other_id, round({duck_inside('p.', 'p.b')}, 6) as inside from ({PAIRS}) p")
def box_containment(spark, sf):
    return spark_sql(spark, sf, PAIRS).select("image_id", "det_id", "other_id", F.round(B.containment(B.box(), B.box("b")), 6).alias("inside"))


@query("select det_id, greatest(0, x1 - trunc((x2 - x1) * 0.15::double)::int)::int as x1, greatest(0, y1 - trunc((y2 - y1) * 0.375::double)::int)::int as y1, least(300, x2 + trunc((x2 - x1) * 0.15::double)::int)::int as x2, least(60, y2 + trunc((y2 - y1) * 0.375::double)::int)::int as y2 from {fx_detections}")
def box_pad(spark, sf):
    cut = B.padded(B.box(), F.lit(300), F.lit(60))
    return fx(spark, sf, "fx_detections").select("det_id", *[c.alias(n) for n, c in zip(B.CORNERS, cut, strict=True)])


@query("select det_id, round_even(x1 + 0.5, 0)::int as x1, y1, round_even(x2 + 1.5, 0)::int as x2, y2 from {fx_detections}")
def poly_to_box(spark, sf):
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x1, y1, x2, y2 = B.box()
    poly = F.array(point(x1 + 0.5, y1), point(x2 + 1.5, y1), point(x2, y2), point(x1 + 2, y2))
    return fx(spark, sf, "fx_detections").select("det_id", *[c.alias(n) for n, c in zip(B.CORNERS, B.of_polygon(poly), strict=True)])


@query("select d.gt_id, greatest(0, x1 - m)::int as x1, greatest(0, y1 - m)::int as y1, least(width, x2 + m)::int as x2, least(height, y2 + m)::int as y2 from (select *, case when category = 'positive' then 4 else 0 end as m from {fx_gt}) d join {fx_images} i on d.image_id = i.image_id")
def crop_box(spark, sf):
    df = fx(spark, sf, "fx_gt").join(fx(spark, sf, "fx_images"), "image_id")
    cut = B.crop(B.box(), F.col("category") == "positive", F.col("width"), F.col("height"))
    return df.select("gt_id", *[c.alias(n) for n, c in zip(B.CORNERS, cut, strict=True)])


WINDOWS = """select image_id, x::int as x1, y::int as y1, (x + 128)::int as x2, (y + 32)::int as y2 from (
  select image_id, unnest(range(0, width - 128 + 1, 32)) as x, height, width from {fx_images}) a, lateral (select unnest(range(0, a.height - 32 + 1, 16)) as y) b
  union all select image_id, (width - 128)::int, y::int, width::int, (y + 32)::int from {fx_images} i, lateral (select unnest(range(0, i.height - 32 + 1, 16)) as y) b where (width - 128) % 32 <> 0
  union all select image_id, x::int, (height - 32)::int, (x + 128)::int, height::int from {fx_images} i, lateral (select unnest(range(0, i.width - 128 + 1, 32)) as x) b where (height - 32) % 16 <> 0"""


@query(WINDOWS)
def sliding_windows(spark, sf):
    return D.sliding_windows(fx(spark, sf, "fx_images"))


#: Larger images, of which the longer side becomes 1024, under windows of two sizes.
LARGE = "select image_id, cast(width * 5 as int) as width, cast(height * 9 as int) as height from {fx_images} where image_id % 3 = 0"
SCALED = "select image_id, least(1.0::double, 1024.0::double / greatest(width, height)) as k, ww, wh, floor(width * least(1.0::double, 1024.0::double / greatest(width, height)) + 0.5)::int as w, floor(height * least(1.0::double, 1024.0::double / greatest(width, height)) + 0.5)::int as h from ({}) i, (values (128, 32), (192, 48)) s(ww, wh)".format(LARGE)


@query(f"""with s as (select * from ({SCALED}) where w >= ww and h >= wh), p as (
  select s.*, x, y from s, lateral (select unnest(range(0, s.w - s.ww + 1, 64)) as x) a, lateral (select unnest(range(0, s.h - s.wh + 1, 48)) as y) b
  union all select s.*, w - ww, y from s, lateral (select unnest(range(0, s.h - s.wh + 1, 48)) as y) b where (w - ww) % 64 <> 0
  union all select s.*, x, h - wh from s, lateral (select unnest(range(0, s.w - s.ww + 1, 64)) as x) a where (h - wh) % 48 <> 0)
select image_id, floor(x / k + 0.5)::int as x1, floor(y / k + 0.5)::int as y1, floor((x + ww) / k + 0.5)::int as x2, floor((y + wh) / k + 0.5)::int as y2 from p""")
def multi_scale_windows(spark, sf):
    return D.sliding_windows(spark_sql(spark, sf, LARGE), stride=(64, 48), scales=(1.0, 1.5))


CLASSES = f"""select image_id, x1, y1, x2, y2, case when p >= 0.3 and p >= n then 'pos' when n >= 0.3 then 'neg' else 'undef' end as class, greatest(p, n) as best_iou from (
  select w.image_id, w.x1, w.y1, w.x2, w.y2, coalesce(max(case when g.category = 'positive' then {duck_iou('w.', 'g.')} end), 0) as p, coalesce(max(case when g.category = 'negative' then {duck_iou('w.', 'g.')} end), 0) as n
  from ({WINDOWS}) w left join {{fx_gt}} g on w.image_id = g.image_id and w.x1 < g.x2 and g.x1 < w.x2 and w.y1 < g.y2 and g.y1 < w.y2 group by all)"""


@query(f"select image_id, x1, y1, x2, y2, class, round(best_iou, 6) as best_iou from ({CLASSES})")
def window_classify(spark, sf):
    return D.classify_sliding(fx(spark, sf, "fx_images"), fx(spark, sf, "fx_gt")).withColumn("best_iou", F.round("best_iou", 6))


READ = "select *, (x1 + y1 + image_id) % 7 <> 0 as passed, (x1 + y1 + image_id) % 3 = 0 as matched, ((x1 * 7 + y1 * 3 + image_id) % 101) / 100.0::double as conf, case when (x1 + image_id) % 5 = 0 then '' else 'E' end as text"


def _read(df):
    k = F.col("x1") + F.col("y1") + F.col("image_id")
    conf = ((F.col("x1") * 7 + F.col("y1") * 3 + F.col("image_id")) % 101) / F.lit(100.0)
    return df.withColumns({"passed": k % 7 != 0, "matched": k % 3 == 0, "conf": conf, "text": F.when((F.col("x1") + F.col("image_id")) % 5 == 0, "").otherwise("E")})


@query(f"""select image_id, class, count(*) as n, count(*) filter (passed) as n_passed, count(*) filter (matched) as n_matched, count(*) filter (matched and conf >= 0.5) as n_high, count(*) filter (text <> '') as n_nonempty, round(sum(conf), 4) as conf_sum
  from ({READ} from ({CLASSES})) group by grouping sets ((image_id, class), (class))""")
def window_stats(spark, sf):
    w = D.classify_sliding(fx(spark, sf, "fx_images"), fx(spark, sf, "fx_gt"))
    return D.window_stats(_read(w)).withColumn("conf_sum", F.round("conf_sum", 4))


@query(f"""select class, x1, y1, image_id, round(conf, 6) as conf, rank from (select *, row_number() over (partition by class order by conf desc, image_id * 1000000 + x1 * 1000 + y1)::int as rank from ({READ} from ({CLASSES})) where matched) where rank <= 5""")
def topk_samples(spark, sf):
    w = _read(D.classify_sliding(fx(spark, sf, "fx_images"), fx(spark, sf, "fx_gt"))).where("matched")
    w = w.withColumn("det_id", F.col("image_id") * 1000000 + F.col("x1") * 1000 + F.col("y1"))
    return D.top_samples(w).select("class", "x1", "y1", "image_id", F.round("conf", 6).alias("conf"), "rank")


@query(f"""with w as ({READ} from ({WINDOWS})), j as (select g.image_id, g.gt_id, coalesce({duck_iou('g.', 'w.')}, 0) as iou, coalesce({duck_inside('g.', 'w.')}, 0) as inside, matched, conf
    from (select * from {{fx_gt}} where category = 'positive') g left join w on w.image_id = g.image_id and w.x1 < g.x2 and g.x1 < w.x2 and w.y1 < g.y2 and g.y1 < w.y2)
  select image_id, gt_id, round(max(iou), 6) as best_iou, round(max(inside), 6) as best_containment, coalesce(bool_or(iou >= 0.3 and matched and conf >= 0.5), false) as recognised, max(iou) >= 0.3 as covered_3, max(iou) >= 0.5 as covered_5, max(iou) >= 0.7 as covered_7, max(inside) >= 0.9 as contained_9 from j group by 1, 2""")
def detector_coverage(spark, sf):
    out = D.coverage_sliding(fx(spark, sf, "fx_images"), fx(spark, sf, "fx_gt"), _read)
    return out.withColumns({c: F.round(c, 6) for c in ("best_iou", "best_containment")})


@query(f"""with recursive o as (select image_id, det_id, text, conf, x1, y1, x2, y2, row_number() over (partition by image_id, text order by conf desc, det_id) as k from {{fx_detections}}),
walk as (select image_id, text, k, [struct_pack(det_id := det_id, x1 := x1, y1 := y1, x2 := x2, y2 := y2)] as kept from o where k = 1
  union all select w.image_id, w.text, o.k, case when len(list_filter(w.kept, lambda q: {duck_iou('q.', 'o.')} >= 0.3)) > 0 then w.kept else list_append(w.kept, struct_pack(det_id := o.det_id, x1 := o.x1, y1 := o.y1, x2 := o.x2, y2 := o.y2)) end
  from walk w join o on o.image_id = w.image_id and o.text = w.text and o.k = w.k + 1),
last as (select *, row_number() over (partition by image_id, text order by k desc) as r from walk)
select d.* from {{fx_detections}} d where det_id in (select unnest(kept).det_id from last where r = 1)""")
def nms_by_text(spark, sf):
    return D.nms_by_text(fx(spark, sf, "fx_detections"))


@query(ORACLES["nms_by_text"])
def nms_streamed(spark, sf):
    return D.suppressed(fx(spark, sf, "fx_detections"), how="stream")


@query(ORACLES["nms_by_text"])
def nms_tiled(spark, sf):
    return D.nms_tiled(fx(spark, sf, "fx_detections"), tile=64)


@query("select image_id, det_id, text, conf, round(conf * 100, 6) as percent, x1, y1, x2, y2 from {fx_detections} qualify row_number() over (partition by image_id order by conf desc, det_id) = 1")
def best_per_image(spark, sf):
    return D.best_per_image(fx(spark, sf, "fx_detections")).withColumn("percent", F.round(F.col("conf") * 100, 6))


CONSENSUS = f"""with recursive a as (select *, row_number() over (partition by image_id, text order by det_id) as k from {{fx_detections}}), b as (select * from {{fx_detections_b}}),
walk as (select image_id, text, 0::bigint as k, null::bigint as det_id, null::bigint as other_id, null::double as iou, []::bigint[] as used from (select distinct image_id, text from a)
  union all select w.image_id, w.text, a.k, a.det_id, m.det_id, m.iou, case when m.det_id is null then w.used else list_append(w.used, m.det_id) end
  from walk w join a on a.image_id = w.image_id and a.text = w.text and a.k = w.k + 1
  left join lateral (select b.det_id, {duck_iou('a.', 'b.')} as iou from b where b.image_id = a.image_id and b.text = a.text and not list_contains(w.used, b.det_id) and {duck_iou('a.', 'b.')} >= 0.5 order by iou desc, b.det_id limit 1) m on true),
m as (select * from walk where k > 0)
select image_id, text, det_id, other_id, round(iou, 6) as iou, case when other_id is null then 'primary_only' else 'both' end as kind from m
union all select image_id, text, null, det_id, null, 'secondary_only' from b where det_id not in (select other_id from m where other_id is not null)"""


@query(CONSENSUS)
def consensus_match(spark, sf):
    return D.consensus(fx(spark, sf, "fx_detections"), fx(spark, sf, "fx_detections_b")).withColumn("iou", F.round("iou", 6))


PIXEL_WINDOWS = "select image_id, w.x1, 2 as y1, w.x1 + 8 as x2, 14 as y2 from (select distinct image_id from {fx_pixels}) i, (values (0), (4), (8)) w(x1)"
MAPS = """with px as (select * from {fx_pixels}), g as (select image_id, x, y, v,
    lag(v) over r as l, lead(v) over r as e, lag(v) over c as u, lead(v) over c as d from px window r as (partition by image_id, y order by x), c as (partition by image_id, x order by y)),
h as (select *, lag(u) over r as ul, lead(u) over r as ue, lag(d) over r as dl, lead(d) over r as de from g window r as (partition by image_id, y order by x)),
m as (select p.image_id, p.x, p.y, coalesce(sqrt(power((ue + 2 * e + de) - (ul + 2 * l + dl), 2) + power((dl + 2 * d + de) - (ul + 2 * u + ue), 2)), 0) as edge,
    (select avg(q.v * q.v) - avg(q.v) * avg(q.v) from px q where q.image_id = p.image_id and q.x between p.x - 2 and p.x + 2 and q.y between p.y - 2 and p.y + 2) as var from h p)"""
FEATURES = f"{MAPS}, f as (select w.image_id, w.x1, w.y1, w.x2, w.y2, avg(edge) as edge_mean, avg(greatest(var, 0)) as var_mean from ({PIXEL_WINDOWS}) w join m on m.image_id = w.image_id and m.x >= w.x1 and m.x < w.x2 and m.y >= w.y1 and m.y < w.y2 group by all)"


def _features(spark, sf):
    images = P.images_of_pixels(fx(spark, sf, "fx_pixels"))
    at = lambda c: F.col(c).cast("int").alias(c)
    windows = images.select("image_id", F.explode(F.array(*[F.lit(x) for x in (0, 4, 8)])).alias("x1")).select("image_id", at("x1"), F.lit(2).alias("y1"), (F.col("x1") + 8).alias("x2"), F.lit(14).alias("y2"))
    return images, windows, P.window_features(images, windows)


@query(f"{FEATURES} select image_id, x1, y1, x2, y2, round(edge_mean + 1e-9, 6) as edge_mean, round(var_mean + 1e-9, 6) as var_mean from f")
def window_features(spark, sf):
    # many means end in a 5 where they are rounded; the addend puts both engines on one side of it
    return _features(spark, sf)[2].withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in ("edge_mean", "var_mean")})


@query(f"{FEATURES} select image_id, x1 from f where edge_mean >= 270 and var_mean >= 100")
def window_prefilter(spark, sf):
    return P.prefilter(_features(spark, sf)[2], 270.0, 100.0).select("image_id", "x1")


@query(f"{FEATURES} select x1, count(*) as n, round(min(edge_mean), 4) as min, round(quantile_cont(edge_mean, 0.25), 4) as p25, round(quantile_cont(edge_mean, 0.5), 4) as p50, round(quantile_cont(edge_mean, 0.75), 4) as p75, round(max(edge_mean), 4) as max, round(avg(edge_mean), 4) as mean from f group by x1")
def feature_percentiles(spark, sf):
    out = D.percentiles(_features(spark, sf)[2], "edge_mean", "x1")
    return out.select("x1", "n", *[F.round(c, 4).alias(c) for c in ("min", "p25", "p50", "p75", "max", "mean")])


def _tensors(spark, sf):
    images, windows, _ = _features(spark, sf)
    return P.crop_tensors(images, windows)


# a tensor's row covers 3/8 of a pixel's height; each pixel is 16 of its columns wide, which are equal, so one is shown
@query(f"""with v as (select w.image_id, w.x1, r, p.x, sum(p.v * (least((r + 1) * 0.375, p.y - 1) - greatest(r * 0.375, p.y - 2))) / 0.375 as v from ({PIXEL_WINDOWS}) w
    join {{fx_pixels}} p on p.image_id = w.image_id and p.x >= w.x1 and p.x < w.x2 and p.y >= 2 and p.y < 14 join range(0, 32) s(r) on r * 0.375 < p.y - 1 and p.y - 2 < (r + 1) * 0.375 group by 1, 2, 3, 4)
  select image_id, x1, 2 as y1, x1 + 8 as x2, 14 as y2, list(round(v::double / 127.5 - 1, 4) order by r, x) as tensor from v group by image_id, x1""")
def crop_tensors(spark, sf):
    shown = F.transform(F.filter("tensor", lambda v, i: i % 16 == 0), lambda v: F.round(v.cast("double"), 4))
    return _tensors(spark, sf).withColumn("tensor", shown)


def _strong_squares(grey, size: int = 4, least: float = 300.0):
    """A detector: the squares of a grid whose mean edge is strong."""
    edge = P.edges(grey)
    return [(x, y, x + size, y + size) for y in range(0, grey.shape[0], size) for x in range(0, grey.shape[1], size) if edge[y : y + size, x : x + size].mean() >= least]


@query(f"{MAPS} select image_id, (x // 4 * 4)::int as x1, (y // 4 * 4)::int as y1, (x // 4 * 4 + 4)::int as x2, (y // 4 * 4 + 4)::int as y2 from m group by image_id, x // 4, y // 4 having avg(edge) >= 300")
def detector_plugin(spark, sf):
    return P.detect(_features(spark, sf)[0], _strong_squares)


def _half_contrast():
    """A scorer: how much brighter the right half is than the left, through a logistic function."""
    import numpy as np

    return lambda batch: 1 / (1 + np.exp(batch[:, :, :64].mean(axis=(1, 2)) - batch[:, :, 64:].mean(axis=(1, 2))))


@query(f"""select w.image_id, w.x1, round(1 / (1 + exp((avg(v) filter (p.x < w.x1 + 4) - avg(v) filter (p.x >= w.x1 + 4)) / 127.5)), 4) as score
  from ({PIXEL_WINDOWS}) w join {{fx_pixels}} p on p.image_id = w.image_id and p.x >= w.x1 and p.x < w.x2 and p.y >= 2 and p.y < 14 group by 1, 2""")
def score_batch(spark, sf):
    return P.score(_tensors(spark, sf), _half_contrast).select("image_id", "x1", F.round(F.col("score").cast("double"), 4).alias("score"))


@query("""with px as (select * from {fx_pixels}), g as (select image_id, lag(v) over r + lead(v) over r + lag(v) over c + lead(v) over c - 4 * v as lap from px window r as (partition by image_id, y order by x), c as (partition by image_id, x order by y))
  select image_id, round(avg(lap * lap) - avg(lap) * avg(lap), 3) as sharpness from g where lap is not null and image_id % 5 = 0 group by image_id having avg(lap * lap) - avg(lap) * avg(lap) > 100""")
def frame_sample(spark, sf):
    frames = P.images_of_pixels(fx(spark, sf, "fx_pixels")).withColumn("ord", F.col("image_id"))
    # halves of a thousandth occur: rounded as doubles, as DuckDB does, not by their decimal digits
    return P.sharp_frames(frames, 5).withColumn("sharpness", F.floor(F.col("sharpness") * 1000 + 0.5) / 1000)
