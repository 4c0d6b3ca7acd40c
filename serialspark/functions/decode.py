"""Decoding of model scores held in array columns: single measures by built-in functions, whole readings in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from serialspark import schemas as S


def once(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def steps(logits: Column, classes: int) -> Column:
    """A flat row-major array cut into one array for each step; the array itself may be an expression, computed once."""

    def cut(flat: Column) -> Column:
        n = F.floor(F.size(flat) / classes).cast("int")
        return F.transform(F.sequence(F.lit(0), n - 1), lambda t: F.slice(flat, t * classes + 1, classes))

    return once(logits, cut)


def softmax(step: Column) -> Column:
    def use(peak: Column) -> Column:
        return once(F.aggregate(step, F.lit(0.0), lambda a, v: a + F.exp(v - peak)), lambda total: F.transform(step, lambda v: F.exp(v - peak) / total))

    return once(F.array_max(step), use)


def top_two(step: Column) -> Column:
    """(ix, top1, ix2, top2, margin) of a step's scores; the first of equal ones comes first."""

    def use(order: Column) -> Column:
        peak, second = order[0], order[1]
        total = F.aggregate(step, F.lit(0.0), lambda a, v: a + F.exp(v - peak))
        ix = F.array_position(step, peak).cast("int") - 1
        later = ix + F.array_position(F.slice(step, ix + 2, F.size(step)), peak).cast("int")
        ix2 = F.when(second == peak, later).otherwise(F.array_position(step, second).cast("int") - 1)
        return once(F.struct(ix.alias("ix"), (F.lit(1.0) / total).alias("top1"), ix2.alias("ix2"), (F.exp(second - peak) / total).alias("top2")), lambda s: F.struct(s["ix"].alias("ix"), s["top1"].alias("top1"), s["ix2"].alias("ix2"), s["top2"].alias("top2"), (s["top1"] - s["top2"]).alias("margin")))

    return once(F.sort_array(step, asc=False), use)


def tops(logits: Column, classes: int) -> Column:
    return F.transform(steps(logits, classes), top_two)


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / F.size(a)


def confidence(top1: Column, margin: Column) -> Column:
    """(confidence, geomean, min_top1, min_margin) of kept steps; zeros if there are none."""
    geo = F.exp(_mean(F.transform(top1, lambda p: F.ln(F.greatest(p, F.lit(1e-9))))))
    some = F.struct(F.least(geo, F.array_min(top1)).alias("confidence"), geo.alias("geomean"), F.array_min(top1).alias("min_top1"), F.array_min(margin).alias("min_margin"))
    zero = F.struct(*[F.lit(0.0).alias(n) for n in ("confidence", "geomean", "min_top1", "min_margin")])
    return F.when(F.size(top1) == 0, zero).otherwise(some)


def _text(ids: Column, alphabet: str) -> Column:
    return F.array_join(F.transform(ids, lambda i: F.substring(F.lit(alphabet), i + 1, F.lit(1))), "")


def emitted(found: Column) -> Column:
    """The steps that put out a character: not blank and not the same as the step before."""
    return F.filter(found, lambda s, t: (s["ix"] != S.CTC_BLANK) & ((t == 0) | (F.element_at(found, F.greatest(t, F.lit(1)))["ix"] != s["ix"])))


def ctc_text(found: Column) -> Column:
    return _text(F.transform(emitted(found), lambda s: s["ix"]), S.CTC_ALPHABET)


def ctc_mean_confidence(logits: Column, found: Column) -> Column:
    """Mean top score of the steps that put out a character; of none, the mean score of blank."""
    kept = F.transform(emitted(found), lambda s: s["top1"])
    blank = F.transform(steps(logits, S.CTC_BLANK + 1), lambda r: softmax(r)[S.CTC_BLANK])
    return F.when(F.size(kept) > 0, _mean(kept)).otherwise(_mean(blank))


def ctc_confidence(found: Column) -> Column:
    """Confidence over all steps that aren't blank."""
    kept = F.filter(found, lambda s: s["ix"] != S.CTC_BLANK)
    return confidence(F.transform(kept, lambda s: s["top1"]), F.transform(kept, lambda s: s["margin"]))


def fixed_text(found: Column) -> Column:
    return _text(F.transform(F.filter(found, lambda s: s["ix"] != S.FIXED_EMPTY), lambda s: s["ix"]), S.FIXED_ALPHABET)


def fixed_confidence(found: Column) -> Column:
    """Confidence over all positions, the empty ones too."""
    return confidence(F.transform(found, lambda s: s["top1"]), F.transform(found, lambda s: s["margin"]))


def detail(found: Column) -> Column:
    """(pos, char, top1, top2_char, top2, margin) of each position; the empty class has no character."""
    char = lambda i: F.when(i != S.FIXED_EMPTY, F.substring(F.lit(S.FIXED_ALPHABET), i + 1, F.lit(1)))
    return F.transform(found, lambda s, t: F.struct(t.alias("pos"), char(s["ix"]).alias("char"), s["top1"].alias("top1"), char(s["ix2"]).alias("top2_char"), s["top2"].alias("top2"), s["margin"].alias("margin")))


READING = T.StructType([T.StructField("head", T.StringType()), T.StructField("text", T.StringType()), T.StructField("confidence", T.DoubleType())])


def _in_order(a: np.ndarray) -> np.ndarray:
    """Sums over the last axis from left to right, as SQL adds; numpy's own order would tell equal confidences apart in another way."""
    out = np.zeros(a.shape[:-1])
    for i in range(a.shape[-1]):
        out += a[..., i]
    return out


def read_steps(scores: np.ndarray) -> tuple[list[str], np.ndarray]:
    """(texts, confidences) of scores (n, steps, classes): 37 classes are read as CTC, 13 as fixed positions."""
    n, steps, classes = scores.shape
    ids = scores.argmax(axis=2)
    top1 = 1 / _in_order(np.exp(scores - scores.max(axis=2, keepdims=True)))
    ctc = classes == S.CTC_BLANK + 1
    if ctc:
        counted = ids != S.CTC_BLANK
        shown = counted.copy()
        shown[:, 1:] &= ids[:, 1:] != ids[:, :-1]
    else:
        counted, shown = np.ones(ids.shape, bool), ids != S.FIXED_EMPTY
    some = counted.sum(axis=1)
    geomean = np.exp(_in_order(np.where(counted, np.log(np.maximum(top1, 1e-9)), 0)) / np.maximum(some, 1))
    least = np.where(counted, top1, np.inf).min(axis=1, initial=np.inf)
    letters = np.frombuffer((S.CTC_ALPHABET if ctc else S.FIXED_ALPHABET).encode() + b"?", np.uint8)[ids]
    texts = [row[own].tobytes().decode() for row, own in zip(letters, shown, strict=True)]
    return texts, np.where(some > 0, np.minimum(geomean, least), 0.0)


@F.pandas_udf(READING)
def dispatched(logits: pd.Series, classes: pd.Series) -> pd.DataFrame:
    """(head, text, confidence) by the number of classes: 37 CTC, 13 fixed of 16 steps; null for other shapes and for scores with a null or no number.

    A batch's rows of one shape are read as one array.
    """
    heads, texts, confidences = ([None] * len(logits) for _ in range(3))
    shapes: dict[tuple[int, int], list[int]] = {}
    for i, (row, n) in enumerate(zip(logits, classes, strict=True)):
        if row is not None and len(row) and not pd.isna(n):
            shapes.setdefault((int(n), len(row)), []).append(i)
    for (n, size), at in shapes.items():
        ctc = n == S.CTC_BLANK + 1 and size % n == 0
        if not ctc and not (n == S.FIXED_EMPTY + 1 and size == S.FIXED_LENGTH * n):
            continue
        scores = np.stack([np.asarray(logits[i], np.float64) for i in at])
        right = np.isfinite(scores).all(axis=1)
        found = read_steps(scores[right].reshape(-1, size // n, n))
        for i, text, confidence in zip(np.array(at)[right].tolist(), *found, strict=True):
            heads[i], texts[i], confidences[i] = "ctc" if ctc else "fixed", text, confidence
    return pd.DataFrame({"head": pd.Series(heads, dtype=object), "text": pd.Series(texts, dtype=object), "confidence": pd.array(confidences, "Float64")})


def with_reading(rows: DataFrame, logits: Column, classes: Column, column: str = "d") -> DataFrame:
    """rows with what dispatched gives. The generator keeps Catalyst from decoding again wherever the result is used."""
    return rows.select("*", F.explode(F.array(dispatched(logits, classes))).alias(column))


def weighted_cross_entropy(logits: Column, target: Column, empty_weight: float) -> Column:
    """(loss, weight): the summed weighted negative log score of the target ids and the sum of weights."""
    pairs = F.zip_with(steps(logits, S.FIXED_EMPTY + 1), target, lambda r, i: F.struct(F.when(i == S.FIXED_EMPTY, empty_weight).otherwise(1.0).alias("w"), (F.ln(F.aggregate(r, F.lit(0.0), lambda a, v: a + F.exp(v - F.array_max(r)))) + F.array_max(r) - F.element_at(r, i + 1)).alias("nll")))
    return F.struct(F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p["w"] * p["nll"]).alias("loss"), F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p["w"]).alias("weight"))
