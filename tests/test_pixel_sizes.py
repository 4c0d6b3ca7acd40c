"""Pixels, tensors and sharpness where only larger tables showed a difference."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from serialspark.operators import pixels as P
from serialspark.plans import catalogue
from serialspark.plans.fixtures import duck, fx


def test_pixels_are_multiplied_in_single_precision(spark, tmp_path):
    v = (np.arange(1, 1000) / 1000).astype(np.float32)
    odd = v[np.floor(v * np.float32(1000)) != np.floor(v.astype(float) * 1000)]
    assert len(odd)
    rows = [np.resize(odd, 64), np.resize(-odd[::-1], 64)]
    pq.write_table(pa.table({"vec_id": pa.array([0, 1]), "embedding": pa.array(rows, pa.list_(pa.float32())), "label": pa.array([0, 1], pa.int32())}), tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    expected = con.execute(duck("select image_id, x, y, v::int from {fx_pixels} order by all")).fetchall()
    got = fx(spark, str(tmp_path), "fx_pixels").select("image_id", "x", "y", F.col("v").cast("int")).orderBy("image_id", "x", "y").collect()
    assert list(map(tuple, got)) == expected


def test_sharpness_of_halves_of_a_thousandth(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = (rng.integers(0, 255, (4000, 64)) / 1000).astype(np.float32)
    pq.write_table(pa.table({"vec_id": pa.array(range(0, 20000, 5)), "embedding": pa.array(list(rows), pa.list_(pa.float32())), "label": pa.array([0] * 4000, pa.int32())}), tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    expected = sorted(con.execute(catalogue.oracle_sql()["frame_sample"]).fetchall())
    got = sorted(map(tuple, catalogue.queries()["frame_sample"](spark, str(tmp_path)).select("image_id", "sharpness").collect()))
    assert got == expected


def test_tensors_leave_in_pieces(spark, monkeypatch):
    images = spark.createDataFrame([(i, 16, 16, bytes(range(256))) for i in range(5)], "image_id long, width int, height int, data binary")
    windows = images.select("image_id", F.lit(2).alias("x1"), F.lit(2).alias("y1"), F.explode(F.array(F.lit(10), F.lit(12))).alias("x2"), F.lit(14).alias("y2"))
    whole = sorted(map(str, P.crop_tensors(images, windows, 8, 4).collect()))
    monkeypatch.setattr(P, "TENSOR_BYTES", 3 * 4 * 8 * 4)
    assert len(whole) == 10 and sorted(map(str, P.crop_tensors(images, windows, 8, 4).collect())) == whole


def test_few_bytes_of_images_are_dealt_to_all_tasks(spark):
    images = spark.createDataFrame([(i, 16, 16, bytes(range(256))) for i in range(40)], "image_id long, width int, height int, data binary")
    windows = images.select("image_id", *[F.lit(v).alias(c) for c, v in zip(("x1", "y1", "x2", "y2"), (2, 2, 10, 14), strict=True)])
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert P.crop_tensors(images, windows, 8, 4).select(F.spark_partition_id().alias("p")).distinct().count() == tasks
