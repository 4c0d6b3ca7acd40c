"""Queries over predictions and training history."""

from __future__ import annotations

from pyspark.sql import functions as F

from serialspark.operators import evaluation as V
from serialspark.plans.fixtures import fx
from serialspark.plans.registry import query

OK = "(pred <> '' and regexp_matches(pred, '^E[39][0-9]{2}MM[0-9]{6}\\z'))"
POS, NEG = "category = 'positive'", "category = 'negative'"


def _measures(ok: str) -> str:
    rate = lambda hit, among: f"round(avg(({hit})::int::double) filter ({among}), 6)"
    cer = f"round(avg(case when gt = '' then (pred <> '')::int::double else levenshtein(pred, gt)::double / length(gt) end) filter ({POS}), 6)"
    return f"""count(*) as n, count(*) filter ({POS}) as n_pos, count(*) filter ({NEG}) as n_neg, {cer} as cer, {rate('pred = gt', POS)} as em, {rate(ok, POS)} as acceptance_recall,
  {rate('pred = gt', f'{POS} and {ok}')} as em_among_accepted, {rate("pred <> ''", NEG)} as fpr_nonempty, {rate(ok, NEG)} as fpr_pattern, {rate(f'not {ok}', NEG)} as rejection_recall"""


@query(f"select {_measures(OK)} from {{fx_predictions}}")
def eval_report(spark, sf):
    return V.rounded(V.report(fx(spark, sf, "fx_predictions")))


@query(f"select coalesce(nullif(subkind, ''), 'unspecified') as subkind, count(*) as n, round(avg({OK}::int::double), 6) as fpr_pattern, round(avg((pred <> '')::int::double), 6) as fpr_nonempty from {{fx_predictions}} where {NEG} group by 1")
def eval_by_subkind(spark, sf):
    return V.rounded(V.by_subkind(fx(spark, sf, "fx_predictions")))


@query("select round(sum(levenshtein(pred, gt))::double / sum(length(gt)), 6) as corpus_cer, round(avg((pred = gt)::int::double), 6) as em from {fx_predictions}")
def eval_corpus_cer(spark, sf):
    return V.rounded(V.corpus_error(fx(spark, sf, "fx_predictions")))


@query(f"select threshold, {_measures(f'({OK} and confidence >= threshold)')} from {{fx_predictions}}, (values (0.0::double), (0.3), (0.5), (0.7), (0.9)) t(threshold) group by threshold")
def threshold_sweep(spark, sf):
    return V.rounded(V.sweep(fx(spark, sf, "fx_predictions"), [0.9, 0.5, 0.0, 0.3, 0.7, 0.5]))


@query(f"select threshold, {_measures(f'({OK} and (threshold is null or confidence >= threshold))')} from {{fx_predictions}}, (values (0.5::double), (null)) t(threshold) group by threshold")
def dual_gate(spark, sf):
    return V.rounded(V.sweep(fx(spark, sf, "fx_predictions"), [None, 0.5]))


B = "select sample_id, case when sample_id % 50 = 0 then concat(gt, 'X') else pred end as pred, gt from {fx_predictions} where sample_id % 7 <> 3"


@query(f"""with a as (select sample_id, pred, gt from {{fx_predictions}}), b as ({B}), j as (select a.gt as ga, b.gt as gb, a.pred as pa, b.pred as pb from a full join b using (sample_id)),
c as (select count(*) filter (ga is not null and gb is not null) as n_both, sum(levenshtein(pa, ga))::double / sum(length(ga)) as cer_a, sum(levenshtein(pb, gb))::double / sum(length(gb)) as cer_b from j)
select n_both, round(cer_a, 6) as cer_a, round(cer_b, 6) as cer_b, round(cer_b - cer_a, 6) as delta, cer_b - cer_a > 0.002 as warn from c""")
def run_compare(spark, sf):
    from serialspark.plans.fixtures import spark_sql

    return V.rounded(V.compare(fx(spark, sf, "fx_predictions"), spark_sql(spark, sf, B)))


@query("""select count(*) as n, count(*) filter (leak) as n_leaks, case when count(*) filter (leak) = 0 then 'clean' else 'blocked' end as verdict
  from (select regexp_matches(pred, 'E[39][0-9]{2}MM[0-9]+') and not starts_with(regexp_extract(pred, 'E[39][0-9]{2}MM[0-9]+'), 'E300MM') as leak from {fx_predictions})""")
def memorization_gate(spark, sf):
    return V.memorization_gate(fx(spark, sf, "fx_predictions"))


@query("""with recursive h as (select run_id, epoch, coalesce(val_cer, 1.0) as cer from {fx_history}),
w as (select run_id, epoch, cer as best, epoch as best_epoch, 0 as wait, null::int as stop from h where epoch = 1
  union all select h.run_id, h.epoch, case when w.stop is null and h.cer < w.best - 1e-6 then h.cer else w.best end, case when w.stop is null and h.cer < w.best - 1e-6 then h.epoch else w.best_epoch end,
    case when w.stop is not null then w.wait when h.cer < w.best - 1e-6 then 0 else w.wait + 1 end, case when w.stop is not null then w.stop when h.cer >= w.best - 1e-6 and w.wait + 1 >= 3 then h.epoch::int end
  from w join h on h.run_id = w.run_id and h.epoch = w.epoch + 1)
select run_id, best_epoch::int as best_epoch, best::double as best_cer, stop::int as stop_epoch from w qualify row_number() over (partition by run_id order by epoch desc) = 1""")
def best_checkpoint(spark, sf):
    return V.best_checkpoints(fx(spark, sf, "fx_history"))


@query("""select engine, round(avg(conf), 6) as mean_conf, count(*) as n from (select 'a' as engine, conf * 100 as conf from {fx_detections} union all select 'b', conf * 100 from {fx_detections_b}) group by engine""")
def engine_adapter(spark, sf):
    side = lambda n, e: fx(spark, sf, n).select(F.lit(e).alias("engine"), (F.col("conf") * 100).alias("conf"))
    return side("fx_detections", "a").unionByName(side("fx_detections_b", "b")).groupBy("engine").agg(F.round(F.avg("conf"), 6).alias("mean_conf"), F.count("*").alias("n"))
