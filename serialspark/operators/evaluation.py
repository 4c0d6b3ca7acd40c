"""Evaluation of predictions (pred, gt, category, subkind, confidence), gates and training history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serialspark import schemas as S
from serialspark.functions import text as X


def _rate(hit: Column, among: Column) -> Column:
    return F.avg(F.when(among, hit.cast("int").cast("double")))


def measures(threshold: float | Column | None = None, pattern: str | None = S.SERIAL_STRICT) -> list[Column]:
    """Aggregates of a report; those of an absent side are null, without a pattern also those that need one."""
    pos, neg = F.col("category") == "positive", F.col("category") == "negative"
    ok = F.lit(None).cast("boolean") if pattern is None else X.accepted(F.col("pred"), F.col("confidence"), threshold, pattern)
    exact = F.col("pred") == F.col("gt")
    count = lambda c: F.count_if(c).alias
    return [
        F.count("*").alias("n"), count(pos)("n_pos"), count(neg)("n_neg"),
        F.avg(F.when(pos, X.error_rate(F.col("pred"), F.col("gt")))).alias("cer"), _rate(exact, pos).alias("em"), _rate(ok, pos).alias("acceptance_recall"),
        _rate(exact, pos & ok).alias("em_among_accepted"), _rate(F.col("pred") != "", neg).alias("fpr_nonempty"), _rate(ok, neg).alias("fpr_pattern"), _rate(~ok, neg).alias("rejection_recall"),
    ]


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def report(predictions: DataFrame, threshold: float | None = None, pattern: str | None = S.SERIAL_STRICT) -> DataFrame:
    return predictions.agg(*measures(threshold, pattern))


def evaluation(predictions: DataFrame, thresholds: Sequence[float] = (), pattern: str | None = S.SERIAL_STRICT) -> DataFrame:
    """The evaluation job: one row a gate, the pattern alone (threshold null) and with each threshold, with subkinds' false rates as a map."""
    gates = sweep(predictions, [None, *thresholds], pattern)
    kinds = by_subkind(predictions, None, pattern).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("subkind", "fpr_nonempty")))).alias("nonempty_by_subkind"))  # subkinds are a handful
    return gates.withColumn("nonempty_by_subkind", kinds.scalar())


def write_report(report: DataFrame, path: str, **head: str) -> None:
    """A report's rows as JSON lines, each with the given fields before its own; null measures are kept."""
    report.select(*[F.lit(v).alias(k) for k, v in head.items()], "*").write.option("ignoreNullFields", False).json(path)


def release_gate(samples: DataFrame, before: DataFrame, after: DataFrame, worse: float = 0.002, strict: bool = False) -> DataFrame:
    """(n_leaks, delta, verdict) of a release: blocked by leaks in run reports' samples, warned of by a worse corpus error.

    With strict, samples without a text block too: a report that can't be read proves nothing.
    """
    gate = memorization_gate(samples).withColumn("n_unread", F.lit(0).cast("long")) if not strict else samples.agg(F.count("*").alias("n"), F.count(X.memorized(F.col("pred"))).alias("n_leaks"), F.count_if(F.col("pred").isNull()).alias("n_unread"))
    change = compare(before, after)
    both = gate.select("n_leaks", "n_unread").withColumn("delta", change.select("delta").scalar()).withColumn("warn", change.select("warn").scalar())
    verdict = F.when((F.col("n_leaks") > 0) | (F.col("n_unread") > 0), "blocked").when(F.col("warn"), "warned").otherwise("clean")
    return both.select("n_leaks", "n_unread", "delta", verdict.alias("verdict"))


def by_subkind(predictions: DataFrame, threshold: float | None = None, pattern: str | None = S.SERIAL_STRICT) -> DataFrame:
    ok = F.lit(None).cast("double") if pattern is None else X.accepted(F.col("pred"), F.col("confidence"), threshold, pattern).cast("int").cast("double")
    kind = F.coalesce(F.nullif("subkind", F.lit("")), F.lit("unspecified")).alias("subkind")
    return predictions.where("category = 'negative'").groupBy(kind).agg(F.count("*").alias("n"), F.avg(ok).alias("fpr_pattern"), F.avg((F.col("pred") != "").cast("int").cast("double")).alias("fpr_nonempty"))


def corpus_error(predictions: DataFrame) -> DataFrame:
    """Edits by reference characters and exact matches, over all rows."""
    return predictions.agg((F.sum(F.levenshtein("pred", "gt")) / F.sum(F.length("gt"))).alias("corpus_cer"), F.avg((F.col("pred") == F.col("gt")).cast("int").cast("double")).alias("em"))


def sweep(predictions: DataFrame, thresholds: Sequence[float | None], pattern: str | None = S.SERIAL_STRICT) -> DataFrame:
    """A report for each threshold, in one pass; None is the pattern alone."""
    wanted = [t for t in thresholds if t is not None]
    if len(wanted) > 100 or any(not 0 <= t <= 1 for t in wanted):
        raise ValueError("up to 100 thresholds from 0 to 1")
    levels = F.array(*[F.lit(t).cast("double") for t in sorted(set(wanted))], *[F.lit(None).cast("double")] * (None in thresholds))
    at = predictions.withColumn("threshold", F.explode(levels))
    # with no threshold every confidence passes
    return at.withColumn("confidence", F.when(F.col("threshold").isNull(), 1.0).otherwise(F.col("confidence"))).groupBy("threshold").agg(*measures(F.coalesce("threshold", F.lit(0.0)), pattern))


def compare(a: DataFrame, b: DataFrame, key: str = "sample_id", worse: float = 0.002) -> DataFrame:
    """Corpus error of two runs over the samples of either, its change, and whether that is a warning."""
    both = a.select(key, F.col("pred").alias("pred_a"), F.col("gt").alias("gt_a")).join(b.select(key, F.col("pred").alias("pred_b"), F.col("gt").alias("gt_b")), key, "full")
    cer = lambda s: F.sum(F.levenshtein(f"pred_{s}", f"gt_{s}")) / F.sum(F.length(f"gt_{s}"))
    out = both.agg(F.count(F.when(F.col("gt_a").isNotNull() & F.col("gt_b").isNotNull(), 1)).alias("n_both"), cer("a").alias("cer_a"), cer("b").alias("cer_b"))
    return out.withColumn("delta", F.col("cer_b") - F.col("cer_a")).withColumn("warn", F.col("delta") > worse)


def memorization_gate(samples: DataFrame, text_col: str = "pred", every: bool = False) -> DataFrame:
    """How many outputs begin a serial that isn't a dummy, and the verdict; with every, any serial of an output counts, not the first alone."""
    leak = F.nullif(F.size(X.memorized_runs(F.col(text_col))), F.lit(0)) if every else X.memorized(F.col(text_col))
    leak = F.when(F.col(text_col).isNotNull(), leak)
    return samples.agg(F.count("*").alias("n"), F.count(leak).alias("n_leaks")).withColumn("verdict", F.when(F.col("n_leaks") == 0, "clean").otherwise("blocked"))


def best_checkpoints(history: DataFrame, patience: int = 3, least: float = 1e-6) -> DataFrame:
    """(run_id, best_epoch, best_cer, stop_epoch) of (run_id, epoch, val_cer): a fold over each run's epochs."""

    def step(s: Column, row: Column) -> Column:
        cer = F.coalesce(row["val_cer"], F.lit(1.0))
        better = cer < s["best"] - least
        going = s["stop"].isNull()
        wait = F.when(better, 0).otherwise(s["wait"] + 1)
        moved = F.struct(F.when(better, cer).otherwise(s["best"]).alias("best"), F.when(better, row["epoch"]).otherwise(s["epoch"]).alias("epoch"), wait.alias("wait"), F.when(wait >= patience, row["epoch"]).alias("stop"))
        return F.when(going, moved).otherwise(s)

    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(None).cast("int").alias("epoch"), F.lit(0).alias("wait"), F.lit(None).cast("int").alias("stop"))
    rows = history.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct(F.col("epoch").cast("int").alias("epoch"), "val_cer"))).alias("rows"))
    out = rows.select("run_id", F.aggregate("rows", start, step).alias("s"))
    return out.select("run_id", F.col("s.epoch").alias("best_epoch"), F.col("s.best").alias("best_cer"), F.col("s.stop").alias("stop_epoch"))
