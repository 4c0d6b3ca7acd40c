"""Queries that decode model scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from serialspark.functions import decode as M
from serialspark.functions import text as X
from serialspark.plans.fixtures import fx
from serialspark.plans.registry import query


def _steps(name: str, classes: int, n: int) -> str:
    """DuckDB: one row for each step, with its best two classes."""
    return f"""
  select *, (case when second = peak then ix + list_position(r[ix + 2 : {classes}], peak) else list_position(r, second) - 1 end)::int as ix2, exp(second - peak) / total as top2, 1 / total as top1
  from (select *, (list_position(r, peak) - 1)::int as ix, list_sum(list_transform(r, lambda v: exp(v - peak))) as total
    from (select vec_id, label, t, r, list_max(r) as peak, list_reverse_sort(r)[2] as second
      from (select vec_id, label, t, logits[t * {classes} + 1 : t * {classes} + {classes}] as r from {{{name}}}, range(0, {n}) s(t))))"""


FIXED, CTC = _steps("fx_fixed", 13, 16), _steps("fx_ctc", 37, 12)
EMIT = f"select *, ix <> 36 and (t = 0 or ix <> lag(ix) over (partition by vec_id order by t)) as emit from ({CTC})"
CONF = "round(least(exp(avg(ln(greatest(top1, 1e-9)))), min(top1)), 6) as confidence, round(exp(avg(ln(greatest(top1, 1e-9)))), 6) as geomean, round(min(top1), 6) as min_top1, round(min(top1 - top2), 6) as min_margin"
DIGITS = "'0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ'"


def _rounded(c: str):
    return [F.round(F.col(c)[f], 6).alias(f) for f in ("confidence", "geomean", "min_top1", "min_margin")]


def _found(spark, sf, name: str, classes: int):
    return fx(spark, sf, name).select("vec_id", "label", "logits", M.tops(F.col("logits"), classes).alias("f"))


@query("""select vec_id, t::int as t, list_transform(r, lambda v: round(exp(v - list_max(r)) / list_sum(list_transform(r, lambda w: exp(w - list_max(r)))), 6)) as p
  from (select vec_id, t, logits[t * 13 + 1 : t * 13 + 13] as r from {fx_fixed}, range(0, 16) s(t))""")
def logits_softmax(spark, sf):
    s = fx(spark, sf, "fx_fixed").select("vec_id", F.posexplode(M.steps(F.col("logits"), 13)).alias("t", "r"))
    return s.select("vec_id", "t", F.transform(M.softmax(F.col("r")), lambda p: F.round(p, 6)).alias("p"))


@query(f"select vec_id, coalesce(string_agg({DIGITS}[ix + 1], '' order by t) filter (emit), '') as text from ({EMIT}) group by vec_id")
def ctc_decode(spark, sf):
    return _found(spark, sf, "fx_ctc", 37).select("vec_id", M.ctc_text(F.col("f")).alias("text"))


@query(f"select vec_id, round(coalesce(avg(top1) filter (emit), avg(exp(r[37] - peak) / total)), 6) as confidence from ({EMIT}) group by vec_id")
def ctc_conf_mean(spark, sf):
    return _found(spark, sf, "fx_ctc", 37).select("vec_id", F.round(M.ctc_mean_confidence(F.col("logits"), F.col("f")), 6).alias("confidence"))


ZERO = "round(coalesce({}, 0), 6)"
SOME = "filter (ix <> 36)"


@query(f"""select vec_id, {ZERO.format(f'least(exp(avg(ln(greatest(top1, 1e-9))) {SOME}), min(top1) {SOME})')} as confidence, {ZERO.format(f'exp(avg(ln(greatest(top1, 1e-9))) {SOME})')} as geomean,
  {ZERO.format(f'min(top1) {SOME}')} as min_top1, {ZERO.format(f'min(top1 - top2) {SOME}')} as min_margin from ({CTC}) group by vec_id""")
def ctc_conf_min(spark, sf):
    return _found(spark, sf, "fx_ctc", 37).select("vec_id", M.ctc_confidence(F.col("f")).alias("c")).select("vec_id", *_rounded("c"))


@query(f"select vec_id, coalesce(string_agg('0123456789EM'[ix + 1], '' order by t) filter (ix <> 12), '') as text, {CONF} from ({FIXED}) group by vec_id")
def fixed_decode(spark, sf):
    return _found(spark, sf, "fx_fixed", 13).select("vec_id", M.fixed_text(F.col("f")).alias("text"), M.fixed_confidence(F.col("f")).alias("c")).select("vec_id", "text", *_rounded("c"))


@query(f"select vec_id, t::int as pos, case when ix <> 12 then '0123456789EM'[ix + 1] end as char, round(top1, 6) as top1, case when ix2 <> 12 then '0123456789EM'[ix2 + 1] end as top2_char, round(top2, 6) as top2, round(top1 - top2, 6) as margin from ({FIXED})")
def fixed_decode_detail(spark, sf):
    d = _found(spark, sf, "fx_fixed", 13).select("vec_id", F.explode(M.detail(F.col("f"))).alias("d")).select("vec_id", "d.*")
    return d.select("vec_id", "pos", "char", *[F.round(c, 6).alias(c) for c in ("top1", "top2", "margin")], "top2_char")


@query(f"""select vec_id, 37 as classes, 'ctc' as head, coalesce(string_agg({DIGITS}[ix + 1], '' order by t) filter (emit), '') as text, round(coalesce(least(exp(avg(ln(greatest(top1, 1e-9))) filter (ix <> 36)), min(top1) filter (ix <> 36)), 0), 6) as confidence from ({EMIT}) group by vec_id
  union all select vec_id, 13, 'fixed', coalesce(string_agg('0123456789EM'[ix + 1], '' order by t) filter (ix <> 12), ''), round(least(exp(avg(ln(greatest(top1, 1e-9)))), min(top1)), 6) from ({FIXED}) group by vec_id
  union all select vec_id, 12, null, null, null from {{fx_fixed}}""")
def decode_dispatch(spark, sf):
    fixed = fx(spark, sf, "fx_fixed")
    rows = fx(spark, sf, "fx_ctc").withColumn("classes", F.lit(37)).unionByName(fixed.withColumn("classes", F.lit(13))).unionByName(fixed.withColumn("classes", F.lit(12)))
    return rows.select("vec_id", "classes", M.dispatched(F.col("logits"), F.col("classes")).alias("d")).select("vec_id", "classes", "d.head", "d.text", F.round("d.confidence", 6).alias("confidence"))


@query("""select label, round(sum(w * nll) / sum(w), 6) as loss from (
  select label, case when c = 12 then 0.3::double else 1.0::double end as w, ln(list_sum(list_transform(r, lambda v: exp(v - list_max(r))))) + list_max(r) - r[c + 1] as nll from (
    select label, logits[t * 13 + 1 : t * 13 + 13] as r, case when t < 12 then instr('0123456789EM', concat('E300MM', lpad((vec_id % 1000000)::varchar, 6, '0'))[t + 1])::int - 1 else 12 end as c from {fx_fixed}, range(0, 16) s(t))) group by label""")
def fixed_ce(spark, sf):
    target = X.encoded_fixed(F.format_string("E300MM%06d", F.col("vec_id") % 1000000))
    e = fx(spark, sf, "fx_fixed").select("label", M.weighted_cross_entropy(F.col("logits"), target, 0.3).alias("e"))
    return e.groupBy("label").agg(F.round(F.sum("e.loss") / F.sum("e.weight"), 6).alias("loss"))
