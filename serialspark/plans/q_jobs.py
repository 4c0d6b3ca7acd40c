"""Whole jobs: images from files, readings from scores, files written and read, evaluation, diagnosis and release."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from serialspark import schemas as C
from serialspark.functions import boxes as B
from serialspark.functions import decode as M
from serialspark.operators import detections as D
from serialspark.operators import evaluation as V
from serialspark.operators import manifests as G
from serialspark.operators import pixels as P
from serialspark.plans import q_data
from serialspark.plans.fixtures import fx, spark_sql
from serialspark.plans.q_decode import _steps
from serialspark.plans.q_evaluation import NEG, OK, _measures
from serialspark.plans.registry import query
from serialspark.sources import files as S
from serialspark.sources.store import place as _place


def _scan(spark, sf):
    """Colour images of 64 columns, a row for each of 64 vectors, written as files and read again."""
    byte = lambda k: F.lpad(F.hex((F.floor(F.abs("v") * 1000) * k % 256).cast("int")), 2, "0")
    cells = spark_sql(spark, sf, "select vec_id, cast(floor(vec_id / 64) as bigint) as image_id, posexplode(embedding) as (x, v) from {embeddings}")
    rows = cells.groupBy("image_id").agg((F.count("*") / 64).cast("int").alias("height"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("vec_id", "x", F.concat(byte(1), byte(3), byte(7)).alias("p")))), lambda s: s["p"]), "").alias("h"))
    folder = _place(spark, "images")
    S.bmp_files(rows.select("image_id", F.lit(64).alias("width"), "height", F.unhex("h").alias("data")), "scan").write.parquet(folder)
    return _images(spark.read.parquet(folder))


def _images(files):
    """Image rows of files named image_<number>.bmp."""
    return S.decoded(files).where("problem is null").select(F.regexp_extract("path", r"image_([0-9]+)\.bmp", 1).cast("long").alias("image_id"), "width", "height", "data")


COLOUR = """select floor(vec_id / 64)::bigint as image_id, x - 1 as x, row_number() over (partition by floor(vec_id / 64), x order by vec_id) - 1 as y, 0.2126 * ((q * 7) % 256) + 0.7152 * ((q * 3) % 256) + 0.0722 * (q % 256) as g
  from (select vec_id, unnest(range(1, 65)) as x, unnest(list_transform(embedding, lambda v: floor(abs(v::double) * 1000)::bigint)) as q from {embeddings})"""


@query(f"select image_id, 64 as width, (count(*) / 64)::int as height, round(avg(g), 4) as luminance from ({COLOUR}) group by image_id")
def image_scan(spark, sf):
    return P.brightness(_scan(spark, sf)).withColumn("luminance", F.round("luminance", 4))


EDGES = f"""with px as ({COLOUR}), g as (select *, lag(g) over r as l, lead(g) over r as e, lag(g) over c as u, lead(g) over c as d from px window r as (partition by image_id, y order by x), c as (partition by image_id, x order by y)),
h as (select *, lag(u) over r as ul, lead(u) over r as ue, lag(d) over r as dl, lead(d) over r as de from g window r as (partition by image_id, y order by x)),
m as (select image_id, x, y, coalesce(sqrt(power((ue + 2 * e + de) - (ul + 2 * l + dl), 2) + power((dl + 2 * d + de) - (ul + 2 * u + ue), 2)), 0) as edge from h)"""


def _edge_boxes(grey, size: int = 16, least: float = 200.0):
    """A detector: the squares of the grid whose mean edge is strong."""
    edge = P.edges(grey)
    return [(x, y, x + size, y + size) for y in range(0, grey.shape[0] - size + 1, size) for x in range(0, grey.shape[1] - size + 1, size) if edge[y : y + size, x : x + size].mean() >= least]


@query(f"{EDGES} select image_id, (x // 16 * 16)::int as x1, (y // 16 * 16)::int as y1, (x // 16 * 16 + 16)::int as x2, (y // 16 * 16 + 16)::int as y2 from m group by image_id, x // 16, y // 16 having count(*) = 256 and avg(edge) >= 200")
def colour_detector(spark, sf):
    return P.detect(_scan(spark, sf), _edge_boxes)


READING_LOGITS = _steps("fx_reading", 13, 16)
READ = f"""select vec_id as det_id, label, string_agg('0123456789EM'[ix + 1], '' order by t) filter (ix <> 12) as text, least(exp(avg(ln(greatest(top1, 1e-9)))), min(top1)) as conf from ({READING_LOGITS}) group by vec_id, label"""


@query(f"""with recursive f as (select det_id % 500 as image_id, det_id, text, 1 as stage, conf, (det_id % 7 * 20)::int as x1, 0 as y1, (det_id % 7 * 20 + 128)::int as x2, 32 as y2 from ({READ}) where regexp_matches(text, '{C.SERIAL_STRICT}') and conf >= 0.5),
o as (select *, row_number() over (partition by image_id, text order by conf desc, det_id) as k from f),
walk as (select image_id, text, 1::bigint as k, [struct_pack(det_id := det_id, x1 := x1, x2 := x2)] as kept from o where k = 1
  union all select w.image_id, w.text, o.k, case when len(list_filter(w.kept, lambda q: greatest(least(q.x2, o.x2) - greatest(q.x1, o.x1), 0) * 32.0 / (256 * 32.0 - greatest(least(q.x2, o.x2) - greatest(q.x1, o.x1), 0) * 32.0) >= 0.3)) > 0 then w.kept
    else list_append(w.kept, struct_pack(det_id := o.det_id, x1 := o.x1, x2 := o.x2)) end from walk w join o on o.image_id = w.image_id and o.text = w.text and o.k = w.k + 1),
last as (select *, row_number() over (partition by image_id, text order by k desc) as r from walk),
ids as (select unnest(kept).det_id as det_id from last where r = 1)
select image_id, det_id, text, stage, floor(conf * 10000 + 0.5) / 10000 as conf, x1, y1, x2, y2, row_number() over (partition by image_id order by conf desc, det_id)::int as rank from f where det_id in (select det_id from ids)""")
def recognize_logits(spark, sf):
    """The whole reading from a model's scores: decode, correct, gate, suppress, rank, round."""
    read = M.with_reading(fx(spark, sf, "fx_reading"), F.col("logits"), F.lit(13))
    at = lambda c: F.expr(c).cast("int")
    found = read.select((F.col("vec_id") % 500).alias("image_id"), F.col("vec_id").alias("det_id"), "d.text", F.col("d.confidence").alias("conf"), at("vec_id % 7 * 20").alias("x1"), F.lit(0).alias("y1"), at("vec_id % 7 * 20 + 128").alias("x2"), F.lit(32).alias("y2"))
    return D.recognized(found, F.col("text"))


@query("select image, id, category, case when category = 'negative' then '' else text end as text, confidence, verified, concat('run_', (id % 3)::varchar) as mined_from, x1, y1, x2, y2 from {fx_regions}")
def annotation_files(spark, sf):
    """Documents with extra fields, written as files and read again."""
    parsed = S.parse_annotations(q_data._documents(spark, sf), extra=True)
    plain = parsed.select("image", S.document_json(image_size=F.col("image_size"), vendor=F.col("vendor")).alias("json"), "extra")
    folder = _place(spark, "annotations")
    S.write_annotations(S.with_own_extra(plain), folder)
    again = S.parse_annotations(S.read_annotation_lines(spark, folder), extra=True)
    return S.regions_of(again).select("image", "id", "category", "text", "confidence", "verified", *B.CORNERS, F.col("extra")["mined_from"].alias("mined_from"))


@query("select filename, coalesce(text, '') as text, split, coalesce(source, '') as source, confidence, coalesce(category, 'positive') as category, coalesce(subkind, '') as subkind from {fx_manifest} where split = 'val'")
def manifest_files(spark, sf):
    """A manifest written as files, of which one split is read again."""
    folder = _place(spark, "manifest")
    S.write_manifest(S.with_defaults(fx(spark, sf, "fx_manifest")), folder)
    return S.read_manifest(spark, f"{folder}/all", "val")


@query(f"""with k as (select map_from_entries(list((s, f) order by s)) as kinds from (select coalesce(nullif(subkind, ''), 'unspecified') as s, round(avg((pred <> '')::int::double), 6) as f from {{fx_predictions}} where {NEG} group by 1))
select threshold, {_measures(f'({OK} and (threshold is null or confidence >= threshold))')}, (select kinds['background'] from k) as fpr_background, (select kinds['mined'] from k) as fpr_mined
from {{fx_predictions}}, (values (0.5::double), (0.9), (null)) t(threshold) group by threshold""")
def evaluate_job(spark, sf):
    """The evaluation job's report, written as files and read again."""
    folder = _place(spark, "evaluation")
    out = V.evaluation(fx(spark, sf, "fx_predictions"), [0.5, 0.9])
    V.write_report(out, folder, split="test", vendor="standard")
    back = spark.read.schema(T.StructType([T.StructField(k, T.StringType()) for k in ("split", "vendor")] + out.schema.fields)).json(folder)
    kind = lambda k: F.round(F.col("nonempty_by_subkind")[k], 6).alias(f"fpr_{k}")
    return V.rounded(back.drop("split", "vendor", "nonempty_by_subkind")).join(back.select(F.col("threshold").alias("t"), kind("background"), kind("mined")), F.col("threshold").eqNullSafe(F.col("t"))).drop("t")


RUNS = "select cast(floor(sample_id / 100) as bigint) as run, sample_id, pred from {fx_predictions}"
RUN_COMPARE = "select sample_id, case when sample_id % 50 = 0 then concat(gt, 'X') else pred end as pred, gt from {fx_predictions} where sample_id % 7 <> 3"


@query(f"""with leaks as (select count(*) filter (regexp_matches(pred, 'E[39][0-9]{{2}}MM[0-9]+') and not starts_with(regexp_extract(pred, 'E[39][0-9]{{2}}MM[0-9]+'), 'E300MM')) as n_leaks from {{fx_predictions}}),
a as (select sample_id, pred, gt from {{fx_predictions}}), b as ({RUN_COMPARE}), j as (select a.gt as ga, b.gt as gb, a.pred as pa, b.pred as pb from a full join b using (sample_id)),
c as (select sum(levenshtein(pb, gb))::double / sum(length(gb)) - sum(levenshtein(pa, ga))::double / sum(length(ga)) as delta from j)
select n_leaks, 0::bigint as n_unread, round(delta, 6) as delta, case when n_leaks > 0 then 'blocked' when delta > 0.002 then 'warned' else 'clean' end as verdict from leaks, c""")
def release_job(spark, sf):
    """Run reports written as files; their samples are checked for leaks, the new run against the old one."""
    folder = _place(spark, "reports")
    sample = F.struct("pred", F.col("sample_id").alias("id"))
    odd = F.col("sample_id") % 2 == 1
    reports = spark_sql(spark, sf, RUNS).groupBy("run").agg(F.collect_list(F.when(odd, sample)).alias("test_samples"), F.collect_list(F.when(~odd, sample)).alias("val_samples"))
    reports.select(F.to_json(F.struct("run", "test_samples", "val_samples")).alias("value")).write.text(folder)
    gate = V.release_gate(S.samples_of_report_lines(spark, folder), fx(spark, sf, "fx_predictions"), spark_sql(spark, sf, RUN_COMPARE), strict=True)
    return gate.withColumn("delta", F.round("delta", 6))


@query("""with w as (select g.image_id, g.gt_id, greatest(least(g.x2, d.x2) - greatest(g.x1, d.x1), 0) * greatest(least(g.y2, d.y2) - greatest(g.y1, d.y1), 0) as inter, (g.x2 - g.x1) * (g.y2 - g.y1) as ga, (d.x2 - d.x1) * (d.y2 - d.y1) as da, d.conf, regexp_matches(d.text, '^E300MM[0-9]{6}\\z') as matched
  from {fx_gt} g left join {fx_detections_b} d on d.image_id = g.image_id and g.x1 < d.x2 and d.x1 < g.x2 and g.y1 < d.y2 and d.y1 < g.y2 where g.category = 'positive'),
b as (select image_id, gt_id, coalesce(max(inter / (ga + da - inter)), 0) as iou, coalesce(max(inter / ga), 0) as inside, coalesce(bool_or(inter / (ga + da - inter) >= 0.3 and matched and conf >= 0.5), false) as ok from w group by 1, 2)
select image_id, count(*) as n, round(avg((iou >= 0.3)::int::double), 6) as covered_3, round(avg((iou >= 0.5)::int::double), 6) as covered_5, round(avg((iou >= 0.7)::int::double), 6) as covered_7, round(avg((inside >= 0.9)::int::double), 6) as contained_9, round(avg(ok::int::double), 6) as recognised,
  round(avg(iou), 6) as mean_iou, round(avg(inside), 6) as mean_containment from b group by grouping sets ((image_id), ())""")
def diagnose_job(spark, sf):
    """How well an engine's boxes cover the truth: ratios of each image and of all."""
    found = fx(spark, sf, "fx_detections_b").withColumn("matched", F.col("text").rlike(C.TRUTH_STRICT))
    return V.rounded(D.coverage_summary(D.coverage(fx(spark, sf, "fx_gt"), found), "image_id"))


@query("""select s as split, count(split) as n, count(*) filter (split is not null and coalesce(category, 'positive') <> 'negative') as n_pos, count(*) filter (category = 'negative') as n_neg from (values ('train'), ('val'), ('holdout')) v(s) left join {fx_manifest} on split = s group by s
  union all select null, count(*), count(*) filter (coalesce(category, 'positive') <> 'negative'), count(*) filter (category = 'negative') from {fx_manifest}""")
def empty_splits(spark, sf):
    return G.counts_of_splits(S.with_defaults(fx(spark, sf, "fx_manifest")), ("train", "val", "holdout"))


@query("select count(*) filter (id % 2 = 0) as n_clear, count(*) filter (id % 2 = 1) as n_blur, 1.5 * count(distinct image) as engine_seconds from {fx_regions}")
def label_quality(spark, sf):
    documents = q_data._documents(spark, sf, old=True).select(F.concat(F.expr("substring(json, 1, length(json) - 1)"), F.lit(',"ocr_elapsed_sec":{"primary":1.5}}')).alias("json"))
    parsed = S.parse_annotations(documents)
    return G.label_quality(S.regions_of(parsed), parsed)
