"""Queries over annotations, regions and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from serialspark.functions import boxes as B
from serialspark.functions import text as X
from serialspark.operators import manifests as G
from serialspark.plans.fixtures import fx, spark_sql
from serialspark.plans.registry import ORACLES, query
from serialspark.sources import files as S
from serialspark.sources.store import place


def _documents(spark, sf, old: bool = False):
    """JSON documents of either generation, one for each image."""
    r = fx(spark, sf, "fx_regions")
    box = F.array("x1", "y1", "x2", "y2").alias("bbox")
    if old:
        each = F.struct("id", box, "text", "confidence", (F.col("id") % 2 == 0).alias("is_clear"))
        name = "labels"
    else:
        each = F.struct("id", "category", box, "text", "text_visible", "subkind", "confidence", F.col("verified").alias("claude_verified"), F.concat(F.lit("run_"), F.col("id") % 3).alias("mined_from"))
        name = "regions"
    grouped = r.groupBy("image").agg(F.array_sort(F.collect_list(each)).alias(name), F.count("*").alias("n"))
    return grouped.select(F.to_json(F.struct("image", F.array(F.lit(1280), F.lit(960)).alias("image_size"), F.lit("v").alias("vendor"), F.lit("fast").alias("mode"), F.lit("x").alias("ignored"), name)).alias("json"))


@query("select image, 2 as schema_version, id, category, text, text_visible, subkind, confidence, verified, x1, y1, x2, y2, 'fast' as mode from {fx_regions}")
def annotations_parse(spark, sf):
    parsed = S.parse_annotations(_documents(spark, sf))
    meta = parsed.select(F.col("image"), F.col("meta")["mode"].alias("mode"), F.size("meta").alias("n_meta")).where("n_meta = 1")
    return S.regions_of(parsed).join(meta.select("image", "mode"), "image").select("image", "schema_version", "id", "category", "text", "text_visible", "subkind", "confidence", "verified", *B.CORNERS, "mode")


@query("select image, 1 as schema_version, id, 'positive' as category, text, 'v' as vendor, case when id % 2 = 0 then 'clear' else 'blur' end as quality, confidence, x1, y1, x2, y2 from {fx_regions}")
def annotations_v1_upgrade(spark, sf):
    return S.regions_of(S.parse_annotations(_documents(spark, sf, old=True))).select("image", "schema_version", "id", "category", "text", "vendor", "quality", "confidence", *B.CORNERS)


@query("select image, id, 1 as n_extra, concat('run_', (id % 3)::varchar) as mined_from from {fx_regions}")
def annotations_extra(spark, sf):
    return S.extras(_documents(spark, sf)).select("image", "id", F.size("extra").alias("n_extra"), F.col("extra")["mined_from"].alias("mined_from"))


@query("select image, id, category, case when category = 'negative' then '' else text end as text, confidence, verified, x1, y1, x2, y2 from {fx_regions}")
def annotations_roundtrip(spark, sf):
    parsed = S.parse_annotations(_documents(spark, sf))
    again = parsed.select(S.document_json(image_size=F.col("image_size"), vendor=F.col("vendor")).alias("json"))
    return S.regions_of(S.parse_annotations(again)).select("image", "id", "category", "text", "confidence", "verified", *B.CORNERS)


BROKEN = """list_filter([case when category = 'negative' and text <> '' then 'negative_has_text' end, case when category = 'positive' and text = '' then 'positive_lacks_text' end,
  case when category = 'positive' and text <> '' and not regexp_matches(text, '^E300MM[0-9]{6}\\z') then 'positive_not_dummy' end, case when regexp_matches(coalesce(text_visible, ''), 'E[39][0-9]{2}MM[0-9]{6}') then 'visible_serial' end,
  case when regexp_matches(coalesce(text_visible, ''), '[0-9]{5,}') then 'visible_digits' end], lambda v: v is not null)"""


@query(f"select id, {BROKEN} as violations from {{fx_regions}}")
def region_violations(spark, sf):
    return fx(spark, sf, "fx_regions").select("id", G.violations(F.col("category"), F.col("text"), F.col("text_visible")).alias("violations"))


@query("select filename, coalesce(text, '') as text, split, coalesce(source, '') as source, confidence, coalesce(category, 'positive') as category, coalesce(subkind, '') as subkind from {fx_manifest} where split = 'train'")
def manifest_read(spark, sf):
    return S.with_defaults(fx(spark, sf, "fx_manifest")).where("split = 'train'")


@query("select filename, starts_with(filename, '/') or list_contains(string_split(filename, '/'), '..') as unsafe from {fx_manifest}")
def path_guard(spark, sf):
    return fx(spark, sf, "fx_manifest").select("filename", G.unsafe(F.col("filename")).alias("unsafe"))


@query("select filename, concat(source, '_', string_split(filename, '/')[-1]) as target from {fx_manifest} where category = 'negative' and subkind = 'background' and not (starts_with(filename, '/') or list_contains(string_split(filename, '/'), '..')) and ascii(right(regexp_replace(filename, '[.]png$', ''), 1)) % 2 = 0")
def background_library(spark, sf):
    m = fx(spark, sf, "fx_manifest")
    present = m.where(F.ascii(F.substring(F.regexp_replace("filename", r"[.]png\z", ""), -1, 1)) % 2 == 0)
    return G.background_library(m, present)


SPLITS = "select concat('img_', cast(cast(floor(o_orderkey / 20) as bigint) as varchar(20)), '.jpg') as image, case when o_custkey % 10 < 7 then 'train' when o_custkey % 10 < 9 then 'val' else 'test' end as split, o_orderkey as ord from {orders} where cast(floor(o_orderkey / 20) as bigint) % 10 <> 9"
SIZES = "select distinct concat('img_', cast(cast(floor(o_orderkey / 20) as bigint) as varchar(20)), '.jpg') as image, cast(640 + cast(floor(o_orderkey / 20) as bigint) % 5 as int) as width, cast(480 as int) as height from {orders} where cast(floor(o_orderkey / 20) as bigint) % 7 <> 3"
CROPS = f"""select concat(s.split, '/', case when category = 'positive' then 'real' else 'real_neg' end, '/', replace(r.image, '.jpg', ''), '_', case when category = 'positive' then 'l' else 'n' end, lpad(id::varchar, greatest(2, length(id::varchar))::int, '0'), '.png') as filename,
  case when category = 'positive' then text else '' end as text, s.split, replace(r.image, '.jpg', '') as source, case when category = 'positive' then coalesce(confidence, 1.0) else 1.0 end::double as confidence, category, case when category = 'positive' then '' else coalesce(subkind, 'background') end as subkind,
  greatest(0, least(width, x1 - m))::int as x1, greatest(0, least(height, y1 - m))::int as y1, greatest(0, least(width, x2 + m))::int as x2, greatest(0, least(height, y2 + m))::int as y2
  from (select *, case when category = 'positive' then 4 else 0 end as m from {{fx_regions}} where verified) r join (select image, arg_min(split, ord) as split from ({SPLITS}) group by image) s on s.image = r.image join ({SIZES}) z on z.image = r.image"""


@query(CROPS)
def manifest_build(spark, sf):
    return G.crops(fx(spark, sf, "fx_regions"), spark_sql(spark, sf, SPLITS), spark_sql(spark, sf, SIZES))


@query(f"select split, category, count(*) as n from ({CROPS}) group by cube (split, category)")
def split_counts(spark, sf):
    return G.split_counts(manifest_build(spark, sf))


@query(f"select r.image, s.split, count(*) as n from {{fx_regions}} r left join (select image, arg_min(split, ord) as split from ({SPLITS}) group by image) s on s.image = r.image group by 1, 2")
def split_assign(spark, sf):
    first = spark_sql(spark, sf, SPLITS).groupBy("image").agg(F.min_by("split", "ord").alias("split"))
    return fx(spark, sf, "fx_regions").join(first, "image", "left").groupBy("image", "split").agg(F.count("*").alias("n"))


@query(f"select r.image, z.image is not null as found, count(*) as n from {{fx_regions}} r left join ({SIZES}) z on z.image = r.image group by 1, 2")
def annotation_image_join(spark, sf):
    r, z = fx(spark, sf, "fx_regions"), spark_sql(spark, sf, SIZES)
    found = r.join(z, "image", "left_semi").withColumn("found", F.lit(True)).unionByName(r.join(z, "image", "left_anti").withColumn("found", F.lit(False)))
    return found.groupBy("image", "found").agg(F.count("*").alias("n"))


@query(f"select distinct image from {{fx_regions}} where image not in (select image from ({SPLITS}))")
def incremental_skip(spark, sf):
    return fx(spark, sf, "fx_regions").select("image").distinct().join(spark_sql(spark, sf, SPLITS), "image", "left_anti")


@query("""select concat('synth/', filename, '_', lpad(v::varchar, 2, '0'), '.png') as filename, concat('synth_', source) as source, coalesce(category, 'positive') as category, case when coalesce(category, 'positive') <> 'negative' then '' when v < 1 then 'other_text' else 'background' end as subkind,
  case when coalesce(category, 'positive') <> 'negative' then 12 else 0 end as text_length from {fx_manifest}, (values (0), (1)) t(v)""")
def synth_manifest(spark, sf):
    return G.synthetic_manifest(S.with_defaults(fx(spark, sf, "fx_manifest"))).select("filename", "source", "category", "subkind", F.length("text").alias("text_length"))


@query("""select source, split, count(*) as n from (select source, split from {fx_manifest} union all select concat('synth_', source), 'train' from {fx_manifest}, (values (0), (1)) t(v)) group by 1, 2""")
def manifest_append(spark, sf):
    real = S.with_defaults(fx(spark, sf, "fx_manifest"))
    return real.unionByName(G.synthetic_manifest(real), allowMissingColumns=True).groupBy("source", "split").agg(F.count("*").alias("n"))


@query("""with m as (select filename, coalesce(category, 'positive') = 'negative' as neg from {fx_manifest}), c as (select count(*) filter (neg) as n_neg, count(*) filter (not neg) as n_pos from m)
  select filename, round(case when neg then 0.4 / n_neg else 0.6 / n_pos end, 10)::double as weight from m, c""")
def sampler_weights(spark, sf):
    return G.sampler_weights(S.with_defaults(fx(spark, sf, "fx_manifest")), 0.4).select("filename", F.round("weight", 10).alias("weight"))


DRAW = "(('0x' || substr(md5(concat_ws('|', {})), 1, 10))::bigint / 1099511627776.0::double)"


def _draw(seed: int, *parts: str) -> str:
    """manifests.uniform in DuckDB."""
    return DRAW.format(", ".join([f"'{seed}'", *[f"({p})::varchar" for p in parts]]))


@query(f"""with m as (select *, category = 'negative' as neg from (select filename, coalesce(text, '') as text, split, source, confidence, coalesce(category, 'positive') as category, coalesce(subkind, '') as subkind from {{fx_manifest}})),
o as (select *, row_number() over (partition by neg order by floor({_draw(2, 'filename')} * 256), filename) - 1 as ordinal from m), t as (select neg, count(*) as total from m group by 1),
d as (select i, i_neg, floor({_draw(1, 'i')} * total)::bigint as ordinal from (select o_orderkey as i, {_draw(0, 'o_orderkey')} < 0.4 as i_neg from {{orders}}) join t on neg = i_neg)
select i, filename, text, split, source, confidence, category, subkind from d join o on o.neg = d.i_neg and o.ordinal = d.ordinal""")
def weighted_sample(spark, sf):
    draws = spark_sql(spark, sf, "select o_orderkey as i from {orders}")
    return G.weighted_sample(S.with_defaults(fx(spark, sf, "fx_manifest")), draws, 0.4)


@query(f"select o_orderkey as i, concat('E300MM', lpad(floor({_draw(0, 'o_orderkey')} * 1000000)::bigint::varchar, 6, '0')) as text from {{orders}}")
def synth_serials(spark, sf):
    return spark_sql(spark, sf, "select o_orderkey as i from {orders}").select("i", G.synthetic_serial(F.col("i")).alias("text"))


@query(f"""select i, case when regexp_matches(t, '^E[39][0-9]{{2}}MM[0-9]{{6}}\\z') then substr(t, 2, 15) else t end as text from (
  select i, string_agg('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ'[floor({_draw(0, 'i', 'k')} * 36)::int + 1], '' order by k) as t
  from (select i, unnest(range(1, floor({_draw(0, 'i', "'n'")} * 11)::int + 6)) as k from (select o_orderkey as i from {{orders}})) group by i)""")
def synth_negatives(spark, sf):
    return spark_sql(spark, sf, "select o_orderkey as i from {orders}").select("i", G.synthetic_negative(F.col("i")).alias("text"))


@query("select source, count(distinct split) as n_splits, count(*) filter (split = 'test' and starts_with(source, 'synth')) as n_synthetic_test from {fx_manifest} group by source having count(distinct split) > 1 or count(*) filter (split = 'test' and starts_with(source, 'synth')) > 0")
def split_leaks(spark, sf):
    return G.split_leaks(fx(spark, sf, "fx_manifest"))


@query("""select o_orderkey, round(case when e <= 1 then 0 when e <= 5 then 0 when e <= 15 then 0.3 * (e - 5) / 10.0 when e <= 40 then 0.3 + 0.1 * (e - 15) / 25.0 else 0.4 end, 6)::double as ratio from (select o_orderkey, o_orderkey % 60 as e from {orders})""")
def ratio_schedule(spark, sf):
    epochs = spark_sql(spark, sf, "select o_orderkey, o_orderkey % 60 as epoch from {orders}")
    return G.scheduled(epochs, [(1, 0.0), (5, 0.0), (15, 0.3), (40, 0.4)]).select("o_orderkey", F.round("ratio", 6).alias("ratio"))


POINTS = "select s_nationkey as schedule, s_suppkey % 40 * 3 as epoch, cast(s_suppkey * 37 % 101 as double) / 101 as ratio from {supplier}"
EPOCHS = "select o_orderkey, o_custkey % 30 as schedule, o_orderkey % 130 as epoch from {orders}"


@query(f"""with p as (select schedule, epoch, min(ratio) as low, max(ratio) as high from ({POINTS}) group by 1, 2), e as ({EPOCHS}),
f as (select schedule, arg_min(low, epoch) as first from p group by 1),
j as (select e.*, a.epoch as a, a.low, a.high, f.first from e left join f using (schedule) asof left join p a on e.schedule = a.schedule and e.epoch >= a.epoch),
k as (select j.*, b.epoch as b, b.low as next from j asof left join p b on j.schedule = b.schedule and j.epoch < b.epoch)
select o_orderkey, round(case when a is null then coalesce(first, 0) when a = epoch then low when b is null then high else high + (next - high) * (epoch - a) / (b - a) end, 6) as ratio from k""")
def ratio_schedules(spark, sf):
    # the points grow with the suppliers, so no limit holds for them
    return G.scheduled_by_table(spark_sql(spark, sf, EPOCHS), spark_sql(spark, sf, POINTS), limit=None).select("o_orderkey", F.round("ratio", 6).alias("ratio"))


@query(ORACLES["manifest_append"])
def incremental_append(spark, sf):
    """Half a manifest, then the real rows, then these again with the made ones, twice: a table that keeps each once."""
    real = S.with_defaults(fx(spark, sf, "fx_manifest"))
    every = real.unionByName(G.synthetic_manifest(real), allowMissingColumns=True)
    path = place(spark, "manifest")
    for rows in (real.where(F.length("filename") % 2 == 0), real, every, every):
        G.append_new(rows, path, ["filename"], "split")
    return spark.read.schema(real.schema).parquet(path).groupBy("source", "split").agg(F.count("*").alias("n"))


NEW = "select image_id, det_id as ord, cast(x1 + det_id % 2 * 128 as int) as x1, y1, cast(x2 + det_id % 2 * 128 as int) as x2, y2 from {fx_detections_b}"


@query(f"""with e as (select image_id, gt_id as id, category, x1, y1, x2, y2 from {{fx_gt}}), k as (select n.* from ({NEW}) n
    where not exists (select 1 from e where e.image_id = n.image_id and category = 'positive' and n.x1 < e.x2 and e.x1 < n.x2 and n.y1 < e.y2 and e.y1 < n.y2)
    and not exists (select 1 from e where e.image_id = n.image_id and category = 'negative' and n.x1 = e.x1 and n.y1 = e.y1 and n.x2 = e.x2 and n.y2 = e.y2))
  select k.image_id, coalesce(t.top, -1) + row_number() over (partition by k.image_id order by ord) as id, x1, y1, x2, y2 from k left join (select image_id, max(id) as top from e group by 1) t on t.image_id = k.image_id""")
def negatives_append(spark, sf):
    existing = fx(spark, sf, "fx_gt").withColumnRenamed("gt_id", "id")
    return G.append_negatives(existing, spark_sql(spark, sf, NEW))


@query("""with r as (select *, coalesce(confidence, 0) as c from {fx_regions})
  select count(distinct image) as n_images, count(*) filter (category = 'positive') as n_pos, count(*) filter (category <> 'positive') as n_neg, count(*) filter (category = 'positive' and c >= 0.95) as conf_high, count(*) filter (category = 'positive' and c >= 0.8 and c < 0.95) as conf_mid,
  count(*) filter (category = 'positive' and c < 0.8) as conf_low, round(count(*) filter (category = 'positive') / count(distinct image)::double, 6) as per_image, count(*) filter (category = 'positive' and c >= 0.8) as n_clear, count(*) filter (category = 'positive' and c < 0.8) as n_blur from r""")
def label_report(spark, sf):
    return G.label_report(fx(spark, sf, "fx_regions")).withColumn("per_image", F.round("per_image", 6))


@query("select text, count(*) as n from {fx_regions} where category = 'positive' and text <> '' group by text having count(*) > 1")
def duplicate_serials(spark, sf):
    return fx(spark, sf, "fx_regions").where("category = 'positive' and text <> ''").groupBy("text").agg(F.count("*").alias("n")).where("n > 1")


@query("select image, count(*) filter (category = 'positive') as n from {fx_regions} group by image")
def labels_per_image(spark, sf):
    return fx(spark, sf, "fx_regions").groupBy("image").agg(F.count_if(F.col("category") == "positive").alias("n")).orderBy(F.desc("n"), "image")


@query("""with c as (select ord, image_id, replace(replace(upper(translate(raw, 'Ｅ０１２３４５６７８９Ｍ', 'E0123456789M')), '-', ''), ' ', '') as n, conf from {fx_raw_text})
  select image_id, count(*) as n_raw, count(*) filter (regexp_matches(n, 'E[39][0-9]{2}MM[0-9]{6}')) as n_candidates, count(*) filter (not regexp_matches(n, 'E[39][0-9]{2}MM[0-9]{6}')) as n_rejected,
  count(*) filter (regexp_matches(n, 'E[39][0-9]{2}MM[0-9]{6}') and conf >= 0.8) as n_clear, count(*) filter (regexp_matches(n, 'E300MM[0-9]{6}')) as n_valid from c group by image_id""")
def autolabel_single(spark, sf):
    c = X.candidate(X.normalized(F.col("raw"), strip_spaces=True))
    df = fx(spark, sf, "fx_raw_text").select("image_id", "conf", c.alias("c"))
    found = F.col("c").isNotNull()
    broken = F.size(G.violations(F.lit("positive"), F.col("c.text"), F.lit(""))) > 0
    return df.groupBy("image_id").agg(F.count("*").alias("n_raw"), F.count_if(found).alias("n_candidates"), F.count_if(~found).alias("n_rejected"), F.count_if(found & (F.col("conf") >= 0.8)).alias("n_clear"), F.count_if(found & ~broken).alias("n_valid"))
