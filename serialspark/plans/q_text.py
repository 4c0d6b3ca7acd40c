"""Queries over recognised text."""

from __future__ import annotations

from pyspark.sql import functions as F

from serialspark import schemas as S
from serialspark.functions import text as X
from serialspark.operators import detections as D
from serialspark.plans.fixtures import fx, spark_sql
from serialspark.plans.registry import query

NORM = "replace(upper(translate(raw, 'Ｅ０１２３４５６７８９Ｍ', 'E0123456789M')), '-', '')"
STRICT, PART = S.SERIAL_STRICT, S.SERIAL_PARTIAL
CORRECTED = f"""
  select *, translate(t, 'O', '0') as z from (select *, {NORM} as t from {{fx_raw_text}})"""
STAGED = f"""
  select *, case when regexp_matches(t, '{STRICT}') then 1 when regexp_matches(z, '{STRICT}') then 2
    when regexp_matches(z, '{PART}') then 5 when regexp_matches(t, '{PART}') then 6 end as stage,
    case when regexp_matches(t, '{STRICT}') then t when regexp_matches(z, '{STRICT}') then z
    when regexp_matches(z, '{PART}') then regexp_extract(z, '{PART}') when regexp_matches(t, '{PART}') then regexp_extract(t, '{PART}') end as text from ({CORRECTED})"""


@query(f"select ord, kind, {NORM} as text from {{fx_raw_text}}")
def normalize_text(spark, sf):
    return fx(spark, sf, "fx_raw_text").select("ord", "kind", X.normalized(F.col("raw")).alias("text"))


@query(f"select ord, replace({NORM}, ' ', '') as text from {{fx_raw_text}}")
def normalize_text_exact(spark, sf):
    return fx(spark, sf, "fx_raw_text").select("ord", X.normalized(F.col("raw"), strip_spaces=True, exact=True).alias("text"))


@query(f"select ord, text, stage from ({STAGED})")
def serial_correction(spark, sf):
    return fx(spark, sf, "fx_raw_text").select("ord", X.corrected(X.normalized(F.col("raw"))).alias("c")).select("ord", "c.text", "c.stage")


@query(f"""select ord, raw, case when regexp_matches(n, '{STRICT}') then n else regexp_extract(n, '{PART}') end as text, case when regexp_matches(n, '{STRICT}') then 'strict' else 'partial' end as match_kind
  from (select *, replace({NORM}, ' ', '') as n from {{fx_raw_text}}) where regexp_matches(n, '{PART}')""")
def serial_candidates(spark, sf):
    c = X.candidate(X.normalized(F.col("raw"), strip_spaces=True))
    return fx(spark, sf, "fx_raw_text").select("ord", "raw", c.alias("c")).where("c is not null").select("ord", "raw", "c.text", "c.match_kind")


VENDORS = "(values ('standard', '^E300MM[0-9]{6}\\z'), ('line5', '^E305MM[0-9]{6}\\z')) v(vendor, strict_re)"


@query(f"select ord, vendor from ({STAGED}) s join (select * from {VENDORS}) v on regexp_matches(s.text, v.strict_re)")
def vendor_match(spark, sf):
    found = fx(spark, sf, "fx_raw_text").select("ord", X.corrected(X.normalized(F.col("raw")))["text"].alias("text"))
    return X.vendors_of(found, F.col("text"), {"standard": "^E300MM[0-9]{6}\\z", "line5": "^E305MM[0-9]{6}\\z"}).select("ord", "vendor")


@query("""select sample_id, regexp_extract(pred, 'E[39][0-9]{2}MM[0-9]+') as leak from {fx_predictions}
  where regexp_matches(pred, 'E[39][0-9]{2}MM[0-9]+') and not starts_with(regexp_extract(pred, 'E[39][0-9]{2}MM[0-9]+'), 'E300MM')""")
def memorized_prefix(spark, sf):
    return fx(spark, sf, "fx_predictions").select("sample_id", X.memorized(F.col("pred")).alias("leak")).where("leak is not null")


@query("""select doc_id, len(regexp_extract_all(text, 'E[39][0-9]{2}MM[0-9]{6}'))::int as n_serials, len(regexp_extract_all(text, '[0-9]{5,}'))::int as n_digit_runs from {documents}""")
def leak_lint(spark, sf):
    a, b = X.leak_counts(F.col("text"))
    return spark_sql(spark, sf, "select doc_id, text from {documents}").select("doc_id", a.cast("int").alias("n_serials"), b.cast("int").alias("n_digit_runs"))


@query("select sample_id, list_transform(list_filter(string_split(gt, ''), lambda c: c <> ''), lambda c: instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c)::int - 1) as ids, length(gt)::int as n from {fx_predictions}")
def encode_ctc(spark, sf):
    return fx(spark, sf, "fx_predictions").select("sample_id", X.encoded(F.col("gt"), S.CTC_ALPHABET).alias("ids"), F.length("gt").alias("n"))


@query("""select sample_id, list_concat(list_transform(list_filter(string_split(gt, ''), lambda c: c <> ''), lambda c: instr('0123456789EM', c)::int - 1), list_transform(range(0, 16 - length(gt)), lambda i: 12)) as ids from {fx_predictions}""")
def encode_fixed(spark, sf):
    return fx(spark, sf, "fx_predictions").select("sample_id", X.encoded_fixed(F.col("gt")).alias("ids"))


@query("select sample_id, round(case when gt = '' then case when pred <> '' then 1.0 else 0.0 end else levenshtein(pred, gt)::double / length(gt) end, 6)::double as cer from {fx_predictions}")
def cer_per_sample(spark, sf):
    return fx(spark, sf, "fx_predictions").select("sample_id", F.round(X.error_rate(F.col("pred"), F.col("gt")), 6).alias("cer"))


@query("select sample_id, pred <> '' and regexp_matches(pred, '^E[39][0-9]{2}MM[0-9]{6}\\z') as by_pattern, pred <> '' and regexp_matches(pred, '^E[39][0-9]{2}MM[0-9]{6}\\z') and confidence >= 0.5 as by_both from {fx_predictions}")
def accept_gate(spark, sf):
    p, c = F.col("pred"), F.col("confidence")
    return fx(spark, sf, "fx_predictions").select("sample_id", X.accepted(p).alias("by_pattern"), X.accepted(p, c, 0.5).alias("by_both"))


READINGS = "select image_id, ord as det_id, raw, conf, cast(ord % 7 * 20 as int) as x1, cast(0 as int) as y1, cast(ord % 7 * 20 + 128 as int) as x2, cast(32 as int) as y2 from {fx_raw_text}"


@query(f"""with recursive f as (select image_id, ord as det_id, text, stage, conf, (ord % 7 * 20)::int as x1, 0 as y1, (ord % 7 * 20 + 128)::int as x2, 32 as y2 from ({STAGED}) where text is not null and conf >= 0.5),
o as (select *, row_number() over (partition by image_id, text order by conf desc, det_id) as k from f),
walk as (
  select image_id, text, 1::bigint as k, [struct_pack(det_id := det_id, x1 := x1, x2 := x2)] as kept from o where k = 1
  union all
  select w.image_id, w.text, o.k, case when len(list_filter(w.kept, lambda q: greatest(least(q.x2, o.x2) - greatest(q.x1, o.x1), 0) * 32.0 / (256 * 32.0 - greatest(least(q.x2, o.x2) - greatest(q.x1, o.x1), 0) * 32.0) >= 0.3)) > 0 then w.kept
    else list_append(w.kept, struct_pack(det_id := o.det_id, x1 := o.x1, x2 := o.x2)) end
  from walk w join o on o.image_id = w.image_id and o.text = w.text and o.k = w.k + 1),
last as (select *, row_number() over (partition by image_id, text order by k desc) as r from walk),
ids as (select unnest(kept).det_id as det_id from last where r = 1)
select image_id, det_id, text, stage, floor(conf * 10000 + 0.5) / 10000 as conf, x1, y1, x2, y2, row_number() over (partition by image_id order by conf desc, det_id)::int as rank from f where det_id in (select det_id from ids)""")
def recognize_batch(spark, sf):
    return D.recognized(spark_sql(spark, sf, READINGS), F.col("raw"))
