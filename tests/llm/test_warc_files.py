"""Archives as streams, hot payloads, and archives of several gzip members."""

import gzip

import pytest
from pyspark.sql.functions import spark_partition_id

from serialspark.llm import common, warc


def record(i, payload):
    return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Page-ID: {i}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload + b"\r\n\r\n"


def test_parse_streams():
    rows = [(i, b"\r\n\r\nWARC/1.1 " * i) for i in range(50)] + [(99, b"x" * 9_000_000)]
    whole = b"".join(record(*r) for r in rows)
    for data in (whole, gzip.compress(whole), b"".join(gzip.compress(record(*r)) for r in rows)):
        assert [(int(h["WARC-Page-ID"]), p) for h, p in warc.parse(data)] == rows
    assert list(warc.parse(b"")) == []
    for broken in (whole[:-9000], b"HTTP/1.1\r\n\r\n", b"WARC/1.1\r\n"):
        with pytest.raises(ValueError):
            list(warc.parse(broken))


def test_hot_keys_join_alike(spark):
    big = spark.range(40000).selectExpr("if(id < 30000, 0, id % 500) as k", "id")
    small = big.groupBy("k").count().withColumnRenamed("count", "n").where("k < 400").selectExpr("k", "n", "k * 2 as v")
    out = common.join_counted(big, small, "k", "n")
    assert out.columns == ["k", "id", "v"] and out.count() == 40000
    assert out.where("v <> k * 2 or (v is null) <> (k >= 400)").count() == 0


def test_a_hot_payload_and_small_files(spark, tmp_path):
    rows = [(i, f"http://h/{i}", "same" if i % 3 else f"own {i}") for i in range(15000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumnRenamed("html", "payload")
    warc.write_archives(df, f"{tmp_path}/a", file_bytes=2_000_000)
    assert len(list((tmp_path / "a").glob("part-*"))) >= 4
    out = warc.resolve(warc.read_archives(spark, f"{tmp_path}/a")).collect()
    assert len(out) == 15000 and {r.refers_to for r in out if r.page_id % 3} == {None, 14999}
    assert {r.record_type for r in out if r.page_id % 3 == 0} == {"response"}


def test_tables_are_dropped(spark, tmp_path):
    mark = common.mark_tables()
    table = common.written(spark.range(5), "some")
    assert table.count() == 5 and common.drop_tables(spark, mark) == 1
    with pytest.raises(Exception):  # noqa: B017
        table.count()


def test_large_pages_have_small_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "MOST_BYTES", 1_000_000)
    rows = [(i, None, ("x" * 300_000 if i % 10 == 0 else "y" * 50) + str(i % 200)) for i in range(400)]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, payload string").coalesce(1), f"{tmp_path}/a")
    sizes = [sum(len(p) for _, p in warc.parse(f.read_bytes())) for f in (tmp_path / "a").glob("part-*")]
    assert max(sizes) <= 1_000_000 and sum(sizes) == sum(len(p) for i, _, p in rows if i >= 200)
    out = {r.page_id: r for r in warc.resolve(warc.read_archives(spark, f"{tmp_path}/a")).collect()}
    assert len(out) == 400 and all(out[i].refers_to == i + 200 and out[i].payload_bytes == len(rows[i][2]) for i in range(200))


def test_responses_are_spread(spark, tmp_path):
    """Responses share no key, and a hot payload's revisits don't meet in one partition."""
    df = spark.range(40_000).selectExpr("id as page_id", "'u' as url", "if(id % 2 = 0, 'same', concat('own ', id)) as payload")
    warc.write_archives(df, f"{tmp_path}/a")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = warc.resolve(warc.read_archives(spark, f"{tmp_path}/a").repartition(8))
        n = sorted(r["count"] for r in out.groupBy(spark_partition_id()).count().collect())
        assert sum(n) == 40_000 and n[-1] <= 20_000 / 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
