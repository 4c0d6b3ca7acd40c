"""Literal cases of the column functions and samplers."""

import pytest
from pyspark.sql import functions as F

from serialspark import schemas as S
from serialspark.functions import decode as M
from serialspark.functions import text as X
from serialspark.operators import detections as D
from serialspark.operators import evaluation as V
from serialspark.operators import manifests as G


def test_correction_stages(spark):
    cases = [("e300-mm-000032", "E300MM000032", 1), ("Ｅ300ＭＭ000032", "E300MM000032", 1), ("E3OOMM0OOO32", "E300MM000032", 2), ("garbage E3OOMM0OOO32 tail", "E300MM000032", 5), ("XXE300MM000032YY", "E300MM000032", 5), ("???", None, None), ("", None, None), (None, None, None)]
    df = spark.createDataFrame([(c[0],) for c in cases], "raw string").select("raw", X.corrected(X.normalized(F.col("raw"), exact=True)).alias("c")).select("raw", "c.*")
    assert sorted(map(tuple, df.collect()), key=str) == sorted(cases, key=str)


def test_a_line_end_is_not_the_end(spark):
    assert not spark.range(1).select(X.accepted(F.lit("E300MM000001\n"))).first()[0]


def test_ctc_decoding(spark):
    rows = []
    for ids in ([10, 10, 36, 11, 12], [36, 36], [10, 36, 10]):
        rows.append(([float(10 if k == i else -10) for i in ids for k in range(37)],))
    df = spark.createDataFrame(rows, "logits array<double>").select("logits", M.tops(F.col("logits"), 37).alias("f"))
    out = df.select(M.ctc_text(F.col("f")).alias("t"), M.ctc_confidence(F.col("f"))["confidence"].alias("c"), M.ctc_mean_confidence(F.col("logits"), F.col("f")).alias("m")).collect()
    assert [r.t for r in out] == ["ABC", "", "AA"]
    assert out[1].c == 0.0 and out[1].m > 0.99 and out[0].c > 0.99


def test_fixed_encoding(spark):
    r = spark.range(1).select(X.encoded_fixed(F.lit("E300MM")).alias("a"), X.encoded_fixed(F.lit("XYZ")).alias("b"), X.encoded_fixed(F.lit("0" * 17)).alias("c")).first()
    assert r.a == [10, 3, 0, 0, 11, 11] + [S.FIXED_EMPTY] * 10 and r.b is None and r.c is None


def test_report(spark):
    rows = [("E300MM000001", "E300MM000001", "positive"), ("E300MM000003", "E300MM000002", "positive"), ("E300MM999999", "E300MM000003", "positive"), ("GARBAGE", "E300MM000004", "positive"), ("", "", "negative"), ("E300MM000009", "", "negative")]
    df = spark.createDataFrame([(*r, "", 0.9) for r in rows], "pred string, gt string, category string, subkind string, confidence double")
    r = V.report(df).first()
    assert (r.em, r.acceptance_recall, r.fpr_pattern) == (0.25, 0.75, 0.5) and abs(r.em_among_accepted - 1 / 3) < 1e-9
    empty = V.report(df.limit(0)).first()
    assert empty.n == 0 and empty.cer is None


def test_windows_limit_and_corner(spark):
    one = lambda w, h: spark.createDataFrame([(1, w, h)], "image_id long, width int, height int")
    assert D.sliding_windows(one(100, 20)).count() == 0
    assert D.sliding_windows(one(2048, 64)).agg(F.max("x2")).first()[0] == 2048
    assert D.sliding_windows(one(150, 40), corner=True).count() == D.sliding_windows(one(150, 40)).count() + 1
    with pytest.raises(Exception, match="windows in one image"):
        D.sliding_windows(one(1000, 1000), limit=10).collect()


def test_weighted_sample_and_generators(spark):
    m = spark.range(1000).select(F.col("id").cast("string").alias("filename"), F.when(F.col("id") % 10 == 0, "negative").otherwise("positive").alias("category"))
    draws = spark.range(4000).withColumnRenamed("id", "i")
    out = G.weighted_sample(m, draws, 0.5)
    assert out.count() == 4000
    assert 0.45 < out.where("category = 'negative'").count() / 4000 < 0.55
    again = G.weighted_sample(m.repartition(7), draws.repartition(3), 0.5)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))
    texts = spark.range(3000).select(G.synthetic_negative(F.col("id")).alias("t"))
    assert texts.where(F.col("t").rlike(S.SERIAL_STRICT) | (F.length("t") < 4) | (F.length("t") > 15)).count() == 0
