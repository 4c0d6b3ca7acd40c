"""Labels with a quarantine, tables that grow, schedules from a table, and gates over every serial."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from serialspark.functions import decode as M
from serialspark.operators import detections
from serialspark.operators import engines as E
from serialspark.operators import evaluation as V
from serialspark.operators import labelling as L
from serialspark.operators import manifests as G
from serialspark.operators import pixels as P
from serialspark.plans import q_labels as Q
from serialspark.plans.fixtures import fx, spark_sql
from serialspark.sources import files as S

RAW = "image_id long, det_id long, raw string, conf double, x1 int, y1 int, x2 int, y2 int"


def readings(spark):
    rows = [(1, 1, "e300-mm 000001", 0.91239, 0, 0, 100, 20), (1, 2, "xxE305MM000002", 0.5, 0, 0, 10, 10), (1, 3, "noise", 0.9, 0, 0, 9, 9), (2, 4, None, 0.9, 0, 0, 9, 9), (2, 5, "E300MM000005!", None, 50, 50, 90, 90)]
    other = spark.createDataFrame([(1, 9, "E300MM000001", 0, 0, 100, 20), (2, 8, "E300MM000005", 500, 0, 600, 20)], "image_id long, det_id long, text string, x1 int, y1 int, x2 int, y2 int")
    images = spark.createDataFrame([(1, 110, 60), (2, 100, 100)], "image_id long, width int, height int")
    return spark.createDataFrame(rows, RAW), other, images


def test_labels_are_parted_and_counted_in_one_pass(spark, tmp_path):
    rows = L.labelled(*readings(spark))
    counts = L.write_labels(rows, f"{tmp_path}/labels")
    assert counts == {"n_raw": 5, "n_accepted": 2, "n_quarantined": 1, "n_rejected": 2, "n_verified": 1, "n_clear": 1}
    get = lambda o: sorted(L.read_labels(rows, f"{tmp_path}/labels", o).collect(), key=lambda r: r.det_id)
    one, five = get("accepted")
    assert (one.text, one.match_kind, one.quality, one.confidence, one.verified, one.x1, one.x2, one.y2) == ("E300MM000001", "strict", "clear", 0.9124, True, 0, 110, 27)
    assert (five.match_kind, five.quality, five.confidence, five.verified) == ("partial", "blur", None, False)
    assert [(r.det_id, r.violations) for r in get("quarantined")] == [(2, ["positive_not_dummy"])] and [r.det_id for r in get("rejected")] == [3, 4]
    docs = {r.image: json.loads(r.json) for r in L.documents(L.read_labels(rows, f"{tmp_path}/labels", "accepted"), readings(spark)[2]).collect()}
    assert docs["img_1.jpg"]["regions"][0]["claude_verified"] is True and "claude_verified" not in docs["img_2.jpg"]["regions"][0]
    with pytest.raises(Exception, match="label 2: positive_not_dummy"):
        L.labelled(*readings(spark), strict=True).collect()


def test_a_repeated_append_adds_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(f"f{i}", f"s{i % 3}", i) for i in range(30)], "name string, part string, n int")
    path = f"{tmp_path}/table"
    read = lambda: sorted(map(tuple, spark.read.schema(rows.schema).parquet(path).select(*rows.columns).collect()))
    G.append_new(rows.where("n < 10"), path, ["name"], "part")
    first = read()
    G.append_new(rows.where("n < 10").withColumn("n", -F.col("n")), path, ["name"], "part")
    assert read() == first
    G.append_new(rows.where("part <> 's2'"), path, ["name"], "part")
    G.append_new(rows, path, ["name"], "part")
    G.append_new(rows, path, ["name"], "part")
    assert read() == sorted(map(tuple, rows.collect()))
    G.append_new(rows.limit(0), path, ["name"], "part")
    assert len(read()) == 30


def test_schedules_from_a_table_are_those_of_lists(spark):
    lists = {1: [(0, 0.0), (10, 0.5), (10, 0.8), (40, 0.2)], 2: [(7, 0.9)], 3: [(3, 0.1), (3, 0.4), (9, 0.4)]}
    points = spark.createDataFrame([(k, e, r) for k, own in lists.items() for e, r in own], "schedule int, epoch int, ratio double")
    epochs = spark.createDataFrame([(k, e) for k in (1, 2, 3, 4) for e in (*range(-3, 50), 5, 5)], "schedule int, epoch int")
    got = sorted((r.schedule, r.epoch, round(r.ratio, 9)) for r in G.scheduled_by_table(epochs, points).collect())
    expected = [(k, r.epoch, round(r.ratio, 9)) for k in (1, 2, 3, 4) for r in G.scheduled(epochs.where(F.col("schedule") == k), lists.get(k, [])).collect()]
    assert got == sorted(expected)
    for bad in (points.withColumn("ratio", F.lit(1.5)), points.withColumn("ratio", F.lit(-0.1))):
        with pytest.raises(Exception, match="ratios from 0 to 1"):
            G.scheduled_by_table(epochs, bad).collect()
    with pytest.raises(Exception, match="up to 2 points"):
        G.scheduled_by_table(epochs, points, limit=2).collect()


def test_the_gate_sees_every_serial(spark):
    df = spark.createDataFrame([("E300MM000001 E305MM000002",), ("E300MM000001",), ("none",), (None,)], "pred string")
    first, every = (V.memorization_gate(df, every=e).first() for e in (False, True))
    assert (first.n_leaks, first.verdict) == (0, "clean") and (every.n, every.n_leaks, every.verdict) == (4, 1, "blocked")


def test_engines_of_two_shapes(spark):
    boxes = spark.createDataFrame([(1, 1, "A", 0.5, 0, 0, 9, 9), (1, 2, "B", 0.5, 1, 1, 9, 9)], "image_id long, det_id long, text string, conf double, x1 int, y1 int, x2 int, y2 int")
    pages = spark.sql("select 1L as image_id, named_struct('words', array(named_struct('text', 'A', 'confidence', 77, 'bbox', named_struct('x0', 3, 'y0', 4, 'x1', 5, 'y1', 6)))) as result union all select 2L, named_struct('words', array())")
    found = E.results({"a": (boxes, E.from_detections), "b": (pages, E.from_pages)})
    best = E.best(found, spark.createDataFrame([(1,), (2,)], "image_id long"), ("a", "b"))
    assert sorted(map(str, (tuple(r) for r in best.collect()))) == sorted(map(str, [("a", 1, "A", 50.0, 0, 0, 9, 9), ("b", 1, "A", 77.0, 3, 4, 5, 6), ("a", 2, *[None] * 6), ("b", 2, *[None] * 6)]))
    assert {(r.engine, r.alike, r.n) for r in E.agreement(best).collect()} == {("a", 2, 1), ("b", 2, 1)}
    with pytest.raises(ValueError, match="engine 'c' gives no x1"):
        E.results({"c": (boxes, lambda df: df.select("image_id", "det_id", "text", "conf", "y1", "x2", "y2").withColumnRenamed("conf", "confidence"))})


def test_schedules_of_any_number_of_points(spark):
    points = spark.range(3000).selectExpr("1L as schedule", "id as epoch", "cast(id % 2 as double) as ratio")
    epochs = spark.createDataFrame([(1, 1500), (1, 2999), (1, 5000)], "schedule long, epoch long")
    got = sorted((r.epoch, r.ratio) for r in G.scheduled_by_table(epochs, points, limit=None).collect())
    assert got == [(1500, 0.0), (2999, 1.0), (5000, 1.0)]
    with pytest.raises(Exception, match="ratios from 0 to 1"):
        G.scheduled_by_table(epochs, points.withColumn("ratio", F.lit(1.5)), limit=None).collect()


def test_equal_confidences_are_summed_in_order():
    """Confidences as sums from left to right, whose last bits decide the order of readings that are equally sure."""
    rng = np.random.default_rng(3)
    scores = rng.integers(0, 11, (400, 16, 13)) / 8
    expected = []
    for row in scores.tolist():
        top = [1 / _sum(math.exp(v - max(step)) for v in step) for step in row]
        expected.append(min(math.exp(_sum(map(math.log, top)) / 16), min(top)))
    assert M.read_steps(scores)[1].tolist() == expected


def _sum(values):
    """Left to right; the built-in sum makes up for lost bits."""
    total = 0.0
    for v in values:
        total += v
    return total


def test_partners_are_those_of_one_after_the_other():
    """Groups side by side give what a plain loop over each gives."""
    rng = np.random.default_rng(11)
    size = rng.integers(1, 12, 300)
    starts, n = np.cumsum(size) - size, int(size.sum())
    at = rng.integers(0, 30, (n, 2))
    boxes, second, known = np.hstack((at, at + rng.integers(1, 4, (n, 2)) * 10)), np.zeros(n, bool), np.ones(n, bool)
    expected = {}
    for g, (lo, m) in enumerate(zip(starts, size, strict=True)):
        cut = lo + int(rng.integers(0, m + 1))
        second[cut : lo + m], known[lo : lo + m] = True, g % 10 != 0
        free = list(range(cut, lo + m)) if g % 10 else []
        for i in range(lo, cut):
            iou = [float(P.best_overlaps(boxes[[i]], boxes[[j]])[0][0, 0]) for j in free]
            if iou and max(iou) >= 0.4:
                expected[i] = free.pop(iou.index(max(iou)))
    other, _ = detections._partners(boxes, second, starts, known, 0.4)
    assert {i: int(j) for i, j in enumerate(other) if j >= 0} == expected and len(expected) > 50


def test_labels_are_verified_by_one_shuffle(spark):
    plan = L.labelled(*readings(spark))._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Join") == 1 and "collect_list" not in plan


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (files.apply(i).getName() for i in range(files.length()))
    return {n for n in names if n.startswith("shuffle_")}


def test_labels_of_dealt_readings_shuffle_once(spark):
    """Both engines' rows come from one shuffle of lineitem, the images from another, and pairing needs none of its own."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sf = "/root/testdata/sf0.001"
        rows = L.labelled(spark_sql(spark, sf, Q.READ, Q.BY_IMAGE), fx(spark, sf, "fx_detections_b", Q.BY_IMAGE), spark_sql(spark, sf, Q.IMAGES, Q.BY_IMAGE))
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("- Exchange hashpartitioning") == 2 and plan.count("ReusedExchange") == 1


def test_labels_leave_no_shuffle_and_no_plain_text(spark, tmp_path):
    before, conf = shuffle_files(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(conf)
    rows = L.labelled(*readings(spark))
    L.write_labels(rows, f"{tmp_path}/labels")
    documents = L.documents(L.read_labels(rows, f"{tmp_path}/labels", "accepted"), readings(spark)[2])
    S.write_annotations(documents, f"{tmp_path}/annotations")
    assert not shuffle_files(spark) - before and spark.conf.get(conf) == was
    assert {f.suffix for f in (tmp_path / "annotations").glob("part-*")} == {".gz"}
    back = S.read_annotation_lines(spark, f"{tmp_path}/annotations")
    assert sorted(r.json for r in back.collect()) == sorted(r.json for r in documents.collect()) and back.count() == 2


def test_partners_of_groups_that_are_longer_than_a_batch(spark):
    """Groups over several batches, and batches of many groups, are paired whole; secondaries that are left stay only with consensus."""
    a = spark.createDataFrame([(i % 3 // 2, i, None if i == 7 else "t", i * 10, 0, i * 10 + 9, 9) for i in range(40)], "image_id long, det_id long, text string, x1 int, y1 int, x2 int, y2 int")
    b = a.where("det_id % 2 = 0").withColumn("det_id", F.col("det_id") + 100)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        out = {r.det_id: r.verified for r in detections.verified(a, b).collect()}
        kinds = {(r.det_id, r.other_id, r.kind) for r in detections.consensus(a.where("det_id < 20"), b).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert out == {i: i % 2 == 0 for i in range(40)}
    assert kinds == {(i, i + 100, "both") if i % 2 == 0 else (i, None, "primary_only") for i in range(20)} | {(None, i + 100, "secondary_only") for i in range(20, 40, 2)}
