"""Colour images, files written and read, evaluation modes, errors, and suppression of large groups."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from serialspark.functions import text as X
from serialspark.operators import detections as D
from serialspark.operators import evaluation as V
from serialspark.operators import manifests as G
from serialspark.operators import pixels as P
from serialspark.sources import files as S

IMAGE = "image_id long, width int, height int, data binary"


def test_luminance_of_colours():
    red, green, blue = bytes([0, 0, 255]), bytes([0, 255, 0]), bytes([255, 0, 0])
    assert np.allclose(P.grey_of(3, 1, red + green + blue), [[0.2126 * 255, 0.7152 * 255, 0.0722 * 255]])
    assert np.allclose(P.grey_of(1, 1, red + b"\x80"), [[0.2126 * 255]]) and P.grey_of(2, 1, b"\x05\x09").tolist() == [[5, 9]]
    with pytest.raises(ValueError):
        P.grey_of(2, 2, b"123")


def test_image_files_and_features(spark, tmp_path):
    rng = np.random.default_rng(1)
    pixels = {i: rng.integers(0, 256, (5 + i, 7, 3)).astype(np.uint8) for i in range(3)}
    df = spark.createDataFrame([(i, 7, 5 + i, p.tobytes()) for i, p in pixels.items()], IMAGE)
    (tmp_path / "images").mkdir()
    for r in S.bmp_files(df, "images").collect():
        (tmp_path / r.path).write_bytes(r.content)
    (tmp_path / "images" / "broken.bmp").write_bytes(b"BM nothing")
    (tmp_path / "images" / "note.txt").write_text("no image")
    back = {int(r.origin[-16:-4]): r for r in S.read_images(spark, f"{tmp_path}/images").collect()}
    assert set(back) == set(pixels) and all(bytes(back[i].data) == p.tobytes() for i, p in pixels.items())
    found = S.decoded(S.image_files(spark, f"{tmp_path}/images")).collect()
    assert {int(r.path[-16:-4]): bytes(r.data) for r in found if r.problem is None} == {i: p.tobytes() for i, p in pixels.items()}
    assert [(r.path.rsplit("/", 1)[1], r.problem, r.width) for r in found if r.problem] == [("broken.bmp", "no BMP file", None)]
    whole = S.encode_bmp(3, 2, bytes(range(18)))
    for content, problem in ((whole[:-1], "77 bytes"), (whole[:28] + b"\x08" + whole[29:], "8 bits"), (None, "no BMP")):
        assert problem in S.decoded(spark.createDataFrame([("x", content)], "path string, content binary")).first().problem
    flat = spark.createDataFrame([(1, 8, 8, bytes([10, 20, 30]) * 64)], IMAGE)
    windows = spark.createDataFrame([(1, 0, 0, 8, 8)], "image_id long, x1 int, y1 int, x2 int, y2 int")
    grey = 0.2126 * 30 + 0.7152 * 20 + 0.0722 * 10
    r = P.window_features(flat, windows).first()
    assert r.edge_mean == 0 and abs(r.var_mean) < 1e-6
    assert np.allclose(P.crop_tensors(flat, windows).first().tensor, grey / 127.5 - 1, atol=1e-6)
    assert abs(P.brightness(flat).first().luminance - grey) < 1e-9


def test_annotations_keep_extra_fields(spark, tmp_path):
    region = {"id": 1, "category": "positive", "bbox": [1, 2, 3, 4], "text": "E300MM000001", "mined_from": 'run "x"', "note": "a\tb"}
    plain = {"id": 2, "category": "negative", "bbox": [5, 6, 7, 8], "text": "no", "claude_verified": True}
    raw = json.dumps({"image": "a.jpg", "image_size": [10, 20], "vendor": 'v "1"', "regions": [region, plain]})
    docs = spark.createDataFrame([(raw,)], "json string")
    parsed = S.parse_annotations(docs)
    out = parsed.select("image", S.document_json(image_size=F.col("image_size"), vendor=F.col("vendor")).alias("json"))
    forged = S.extras(docs).withColumn("extra", F.map_concat("extra", F.create_map(F.lit("text"), F.lit("forged"))))
    S.write_annotations(S.with_extra(out, forged), f"{tmp_path}/a")
    got = json.loads(S.read_annotation_lines(spark, f"{tmp_path}/a").first().json)
    one, two = got["regions"]
    assert (got["image"], got["image_size"], got["vendor"], got["schema_version"]) == ("a.jpg", [10, 20], 'v "1"', 2)
    assert one == {k: region[k] for k in one} and one["mined_from"] == 'run "x"' and one["note"] == "a\tb"
    assert two["text"] == "" and two["claude_verified"] is True
    (tmp_path / "b.json").write_text(raw)
    assert S.regions_of(S.parse_annotations(S.read_annotations(spark, f"{tmp_path}/b.json"))).count() == 2


def test_manifest_files(spark, tmp_path):
    rows = [("a.png", "E300MM000001", "train", "s", 0.5, "positive", ""), ("b.png", "", "val", "s", 1.0, "negative", "background")]
    df = spark.createDataFrame(rows, "filename string, text string, split string, source string, confidence double, category string, subkind string")
    S.write_manifest(df, f"{tmp_path}/m")
    assert sorted(map(tuple, S.read_manifest(spark, f"{tmp_path}/m/all").collect())) == rows
    assert [tuple(r) for r in S.read_manifest(spark, f"{tmp_path}/m/splits/part=val").collect()] == [rows[1]]
    with pytest.raises(ValueError):
        S.read_manifest(spark, f"{tmp_path}/m/all", "test")
    assert {r.split: (r.n, r.n_pos, r.n_neg) for r in G.counts_of_splits(df).collect()} == {"train": (1, 1, 0), "val": (1, 0, 1), "test": (0, 0, 0), None: (2, 1, 1)}


def test_run_reports_and_the_release_gate(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"test_samples": [{"pred": "E300MM000001"}, "odd"], "val_samples": [{"pred": "E305MM1"}]}))
    samples = S.samples_of_reports(spark, f"{tmp_path}/r.json")
    assert sorted((r.source, r.pred or "") for r in samples.collect()) == [("test_samples", ""), ("test_samples", "E300MM000001"), ("val_samples", "E305MM1")]
    runs = spark.createDataFrame([(1, "ab", "ab"), (2, "cd", "cd")], "sample_id long, pred string, gt string")
    worse = runs.withColumn("pred", F.lit("xx"))
    clean = samples.where("pred like 'E300%'")
    gate = lambda *a, **k: V.release_gate(*a, **k).first()
    assert gate(samples, runs, runs).verdict == "blocked" and gate(clean, runs, runs).verdict == "clean" and gate(clean, runs, worse).verdict == "warned"
    unread = samples.where("source = 'test_samples'")
    assert gate(unread, runs, runs).verdict == "clean" and gate(unread, runs, runs, strict=True).verdict == "blocked"


def test_evaluation_without_a_pattern(spark, tmp_path):
    rows = [("A1", "A1", "positive", "", 0.9), ("", "", "negative", "mined", 0.1), ("B2", "", "negative", "", 0.9)]
    df = spark.createDataFrame(rows, "pred string, gt string, category string, subkind string, confidence double")
    r = V.report(df, pattern=None).first()
    assert (r.n, r.em, r.fpr_nonempty) == (3, 1.0, 0.5) and (r.acceptance_recall, r.em_among_accepted, r.fpr_pattern, r.rejection_recall) == (None,) * 4
    assert V.report(df, pattern="^[A-Z][0-9]\\z").first().fpr_pattern == 0.5
    V.write_report(V.evaluation(df, [0.5]), f"{tmp_path}/report", split="test")
    lines = [json.loads(x) for p in (tmp_path / "report").glob("part-*") for x in p.read_text().splitlines()]
    assert sorted(str(x["threshold"]) for x in lines) == ["0.5", "None"] and lines[0]["split"] == "test" and lines[0]["nonempty_by_subkind"] == {"mined": 0.0, "unspecified": 1.0}


def test_vendors(spark):
    known = {"standard": "^E300MM[0-9]{6}\\z"}
    assert X.vendor_pattern("standard", known) == known["standard"]
    with pytest.raises(ValueError, match="unknown vendor"):
        X.vendor_pattern("other", known)
    df = spark.createDataFrame([("standard",), (None,)], "vendor string")
    assert df.select(X.known_vendor(F.col("vendor"), known).alias("v")).count() == 2
    with pytest.raises(Exception, match="unknown vendor other"):
        spark.createDataFrame([("other",)], "vendor string").select(X.known_vendor(F.col("vendor"), known)).collect()


def test_streamed_suppression_equals_the_fold(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("image_id"), F.col("id").alias("det_id"), F.lit("same").alias("text"), (F.col("id") * 37 % 101 / 101).alias("conf"), *[(F.col("id") * k % 400 + add).cast("int").alias(c) for c, k, add in (("x1", 7, 0), ("y1", 11, 0))])
    df = df.withColumns({"x2": F.col("x1") + 60, "y2": F.col("y1") + 40})
    key = lambda out: sorted(r.det_id for r in out.select("det_id").collect())
    assert key(D.nms_streamed(df)) == key(D.nms_by_text(df)) and 3 < len(key(D.nms_streamed(df))) < 3000
    assert D.nms_streamed(df.limit(0)).count() == 0 and D.nms_streamed(df).columns == df.columns


def test_consensus_takes_the_best_free_box(spark):
    schema = "image_id long, text string, det_id long, x1 int, y1 int, x2 int, y2 int"
    a = spark.createDataFrame([(1, "t", 1, 0, 0, 10, 10), (1, "t", 2, 0, 0, 10, 10), (2, "t", 3, 0, 0, 10, 10)], schema)
    b = spark.createDataFrame([(1, "t", 7, 0, 0, 10, 10), (1, "t", 8, 0, 0, 10, 9), (1, "t", 9, 90, 90, 99, 99), (3, "u", 5, 0, 0, 1, 1)], schema)
    got = sorted((r.det_id or 0, r.other_id or 0, r.kind) for r in D.consensus(a, b).collect())
    assert got == [(0, 5, "secondary_only"), (0, 9, "secondary_only"), (1, 7, "both"), (2, 8, "both"), (3, 0, "primary_only")]


def test_extra_fields_stay_in_their_task(spark, tmp_path):
    """Extra fields go and come with their document, without a shuffle; regions that repeat an id keep their own."""
    region = {"id": 1, "category": "positive", "bbox": [1, 2, 3, 4], "text": "E300MM000001", "mined_from": 'run "x"'}
    other = {**region, "mined_from": "y", "note": "a\tb"}
    raw = json.dumps({"image": "a.jpg", "image_size": [10, 20], "vendor": "v", "regions": [region, other]})
    old = json.dumps({"image": "b.jpg", "image_size": [10, 20], "labels": [{"id": 7, "bbox": [1, 2, 3, 4], "text": "E300MM000007"}]})
    parsed = S.parse_annotations(spark.createDataFrame([(raw,), (old,)], "json string"), extra=True)
    out = S.with_own_extra(parsed.select("image", S.document_json(image_size=F.col("image_size"), vendor=F.col("vendor")).alias("json"), "extra"))
    S.write_annotations(out, f"{tmp_path}/a")
    back = S.regions_of(S.parse_annotations(S.read_annotation_lines(spark, f"{tmp_path}/a"), extra=True))
    assert sorted((r.image, r.id, r.text, sorted((r.extra or {}).items())) for r in back.collect()) == [("a.jpg", 1, "E300MM000001", [("mined_from", 'run "x"')]), ("a.jpg", 1, "E300MM000001", [("mined_from", "y"), ("note", "a\tb")]), ("b.jpg", 7, "E300MM000007", [])]
    assert all("Exchange" not in df._jdf.queryExecution().executedPlan().toString() for df in (out, back))
