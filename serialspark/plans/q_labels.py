"""The labelling job: two engines' readings become documents, a quarantine and a report; the gate over every serial of an output."""

from __future__ import annotations

from pyspark.sql import functions as F

from serialspark import schemas as C
from serialspark.functions import boxes as B
from serialspark.operators import engines as E
from serialspark.operators import evaluation as V
from serialspark.operators import labelling as L
from serialspark.plans.fixtures import fx, spark_sql
from serialspark.plans.q_boxes import CONSENSUS
from serialspark.plans.registry import query
from serialspark.sources import files as S
from serialspark.sources.store import place

READ = "select image_id, det_id, case when det_id % 13 = 0 then replace(text, 'E300', 'e305 ') when det_id % 17 = 0 then 'noise' else concat(' ', lower(text)) end as raw, conf, x1, y1, x2, y2 from {fx_detections}"
IMAGES = "select distinct image_id, cast(300 as int) as width, cast(60 as int) as height from {fx_detections}"
PRIMARY = f"select * from (select * exclude (raw), nullif(regexp_extract(replace(upper(raw), ' ', ''), '{C.SERIAL_PARTIAL}'), '') as text from ({READ})) where text is not null"
LABELS = f"""select r.*, p.text, case when p.text is null then 'rejected' when not regexp_matches(p.text, '{C.TRUTH_STRICT}') then 'quarantined' else 'accepted' end as outcome, coalesce(b.kind = 'both', false) as verified
  from ({READ}) r left join ({PRIMARY}) p using (det_id) left join (select det_id, kind from ({CONSENSUS.replace('from {fx_detections})', f'from ({PRIMARY}))')}) where kind = 'both') b using (det_id)"""
BOX = "greatest(0, x1 - trunc((x2 - x1) * 0.15::double)::int)::int as x1, greatest(0, y1 - trunc((y2 - y1) * 0.375::double)::int)::int as y1, least(300, x2 + trunc((x2 - x1) * 0.15::double)::int)::int as x2, least(60, y2 + trunc((y2 - y1) * 0.375::double)::int)::int as y2"

#: Detections are made from lineitem, an image from an order: dealt out by it once, both engines' rows lie with their image.
BY_IMAGE = {"lineitem": "l_orderkey"}


def _labels(spark, sf):
    """(rows, where they are written, counts)"""
    rows = L.labelled(spark_sql(spark, sf, READ, BY_IMAGE), fx(spark, sf, "fx_detections_b", BY_IMAGE), spark_sql(spark, sf, IMAGES, BY_IMAGE))
    path = place(spark, "labels")
    return rows, path, L.write_labels(rows, path)


@query(f"select concat('img_', image_id::varchar, '.jpg') as image, det_id as id, 'positive' as category, text, case when conf >= 0.8 then 'clear' else 'blur' end as quality, round(conf, 4) as confidence, verified, {BOX} from ({LABELS}) where outcome = 'accepted'")
def autolabel_accepted(spark, sf):
    """Accepted labels as annotation files, read again."""
    rows, path, _ = _labels(spark, sf)
    folder = place(spark, "annotations")
    S.write_annotations(L.documents(L.read_labels(rows, path, "accepted"), spark_sql(spark, sf, IMAGES, BY_IMAGE)), folder)
    return S.regions_of(S.parse_annotations(S.read_annotation_lines(spark, folder))).select("image", "id", "category", "text", "quality", "confidence", "verified", *B.CORNERS)


@query(f"select image_id, det_id, raw, text, ['positive_not_dummy'] as violations from ({LABELS}) where outcome = 'quarantined'")
def autolabel_quarantined(spark, sf):
    rows, path, _ = _labels(spark, sf)
    return L.read_labels(rows, path, "quarantined").select("image_id", "det_id", "raw", "text", "violations")


@query(f"select count(*) as n_raw, count(*) filter (outcome = 'accepted') as n_accepted, count(*) filter (outcome = 'quarantined') as n_quarantined, count(*) filter (outcome = 'rejected') as n_rejected, count(*) filter (outcome = 'accepted' and verified) as n_verified, count(*) filter (outcome = 'accepted' and conf >= 0.8) as n_clear from ({LABELS})")
def autolabel_report(spark, sf):
    """Counts taken while the labels were written."""
    counts = _labels(spark, sf)[2]
    return spark.createDataFrame([tuple(counts.values())], ", ".join(f"{k} long" for k in counts))


@query("select count(*) as n, count(*) filter (len(list_filter(regexp_extract_all(pred, 'E[39][0-9]{2}MM[0-9]+'), lambda x: not starts_with(x, 'E300MM'))) > 0) as n_leaks, 'blocked' as verdict from (select concat(gt, ' ', pred) as pred from {fx_predictions})")
def memorization_gate_every(spark, sf):
    """Outputs of two serials, of which the second may be the one that leaks."""
    both = fx(spark, sf, "fx_predictions").select(F.concat("gt", F.lit(" "), "pred").alias("pred"))
    return V.memorization_gate(both, every=True)


ENGINES = """select 'boxes' as engine, image_id, det_id as k, text, conf * 100 as confidence, x1, y1, x2, y2 from {fx_detections}
  union all select 'pages', image_id, row_number() over (partition by image_id order by det_id), text, round(conf * 100)::double, x1, y1, x2, y2 from {fx_detections_b}"""


@query(f"""with f as ({ENGINES}), b as (select * from f qualify row_number() over (partition by engine, image_id order by confidence desc, k) = 1)
select e.engine, i.image_id, b.text, round(b.confidence, 6) as confidence, b.x1, b.y1, b.x2, b.y2 from (select distinct image_id from {{fx_detections}}) i cross join (values ('boxes'), ('pages')) e(engine) left join b using (engine, image_id)""")
def engine_results(spark, sf):
    """Two engines of different shapes and scales, brought to one schema; the best of each image, or none."""
    word = F.struct("det_id", "text", F.round(F.col("conf") * 100).alias("confidence"), F.struct(F.col("x1").alias("x0"), F.col("y1").alias("y0"), F.col("x2").alias("x1"), F.col("y2").alias("y1")).alias("bbox"))
    pages = fx(spark, sf, "fx_detections_b").groupBy("image_id").agg(F.struct(F.array_sort(F.collect_list(word)).alias("words")).alias("result"))
    boxes = fx(spark, sf, "fx_detections")
    found = E.results({"boxes": (boxes, E.from_detections), "pages": (pages, E.from_pages)})
    return E.best(found, boxes, ("boxes", "pages")).withColumn("confidence", F.round("confidence", 6))
