"""Inputs of the operators, derived from the given tables by SQL that Spark and DuckDB read alike.

Names in braces are tables or other fixtures. In Spark a table is read straight from its file, so no views are registered.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

SQL = {
    "fx_detections": """
        select l_orderkey as image_id,
          l_orderkey*100 + row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as det_id,
          concat('E300MM', lpad(cast((l_orderkey*4 + l_suppkey % 2) % 1000000 as varchar(20)), 6, '0')) as text,
          cast(l_quantity as int)*2/cast(100 as double) as conf,
          cast((l_partkey % 3)*60 + (l_linenumber*7) % 20 as int) as x1, cast((l_partkey % 2)*16 as int) as y1,
          cast((l_partkey % 3)*60 + (l_linenumber*7) % 20 + 128 as int) as x2, cast((l_partkey % 2)*16 + 32 as int) as y2
        from {lineitem}""",
    "fx_detections_b": """
        select image_id, det_id + 50 as det_id,
          case when det_id % 11 = 0 then 'E300MM999999' else text end as text,
          (1 - conf) as conf,
          cast(x1 + (det_id % 3)*24 as int) as x1, y1, cast(x2 + (det_id % 3)*24 as int) as x2, y2
        from {fx_detections} where det_id % 5 <> 0""",
    "fx_raw_text": """
        select o_orderkey as ord, o_orderkey % 500 as image_id, cast(o_custkey % 8 as int) as kind,
          case o_custkey % 8
            when 0 then concat('E300MM', lpad(cast(o_orderkey % 1000000 as varchar(20)), 6, '0'))
            when 1 then concat('e300-mm-', lpad(cast(o_orderkey % 1000000 as varchar(20)), 6, '0'))
            when 2 then concat('E3OOMM', lpad(cast(o_orderkey % 1000000 as varchar(20)), 6, '0'))
            when 3 then concat('garbage E3OOMM', lpad(cast(o_orderkey % 1000000 as varchar(20)), 6, '0'), ' tail')
            when 4 then concat('XXE305MM', lpad(cast(o_orderkey % 1000000 as varchar(20)), 6, '0'), 'YY')
            when 5 then concat('Ｅ300ＭＭ', lpad(cast(o_orderkey % 1000000 as varchar(20)), 6, '0'))
            when 6 then concat('E103MM', lpad(cast(o_orderkey % 1000000 as varchar(20)), 6, '0'))
            else '???' end as raw,
          cast(o_custkey % 101 as double)/cast(100 as double) as conf
        from {orders}""",
    "fx_predictions": """
        select o_orderkey as sample_id,
          case when o_orderkey % 10 < 6 then 'positive' else 'negative' end as category,
          case when o_orderkey % 10 < 6 then '' when o_orderkey % 10 = 6 then 'background' when o_orderkey % 10 = 7 then 'other_text' when o_orderkey % 10 = 8 then 'mined' else '' end as subkind,
          case when o_orderkey % 10 < 6 then concat('E300MM', lpad(cast(o_orderkey % 1000000 as varchar(20)), 6, '0')) else '' end as gt,
          case o_custkey % 7 when 0 then '' when 1 then 'GARBAGE'
            when 2 then concat('E300MM', lpad(cast((o_orderkey + 1) % 1000000 as varchar(20)), 6, '0'))
            when 3 then concat('E3OOMM', lpad(cast(o_orderkey % 1000000 as varchar(20)), 6, '0'))
            when 4 then concat('E305MM', lpad(cast(o_orderkey % 100000 as varchar(20)), 5, '0'))
            else concat('E300MM', lpad(cast(o_orderkey % 1000000 as varchar(20)), 6, '0')) end as pred,
          cast(o_custkey % 101 as double)/cast(100 as double) as confidence
        from {orders}""",
    "fx_regions": """
        select cast(floor(o_orderkey / 20) as bigint) as image_no, concat('img_', cast(cast(floor(o_orderkey / 20) as bigint) as varchar(20)), '.jpg') as image, o_orderkey as id,
          case when o_custkey % 3 = 0 then 'negative' else 'positive' end as category,
          case when o_custkey % 30 = 1 then '' when o_custkey % 30 = 2 then 'E305MM999999' when o_custkey % 30 = 3 then 'OOPS'
            when o_custkey % 3 = 0 then '' else concat('E300MM', lpad(cast(o_orderkey % 1000000 as varchar(20)), 6, '0')) end as text,
          case when o_custkey % 30 = 6 then 'id 12345' when o_custkey % 30 = 9 then 'see E300MM000001' when o_custkey % 30 = 12 then 'WARNING' else null end as text_visible,
          case when o_custkey % 3 = 0 then case when o_custkey % 2 = 0 then 'background' else 'other_text' end else null end as subkind,
          case when o_custkey % 4 = 0 then null else cast(o_custkey % 101 as double)/cast(100 as double) end as confidence,
          (o_custkey % 5 <> 0) as verified,
          cast(o_orderkey % 900 as int) as x1, cast(o_custkey % 700 as int) as y1,
          cast(o_orderkey % 900 + 150 as int) as x2, cast(o_custkey % 700 + 34 as int) as y2
        from {orders}""",
    "fx_images": """
        select o_orderkey as image_id, cast(200 + (o_orderkey % 5)*70 as int) as width, cast(80 + (o_orderkey % 4)*30 as int) as height
        from {orders}""",
    "fx_gt": """
        select d.image_id, d.det_id as gt_id, case when d.det_id % 3 = 0 then 'negative' else 'positive' end as category,
          d.text, d.x1, d.y1, d.x2, d.y2
        from {fx_detections} d join {fx_images} i on d.image_id = i.image_id""",
    "fx_manifest": """
        select case when c_custkey % 97 = 0 then concat('/abs/', c_name) when c_custkey % 89 = 0 then concat('train/../', c_name)
            else concat('train/real/', c_name, '.png') end as filename,
          case when c_custkey % 4 = 0 then '' else concat('E300MM', lpad(cast(c_custkey as varchar(20)), 6, '0')) end as text,
          case when c_custkey % 10 < 7 then 'train' when c_custkey % 10 < 9 then 'val' else 'test' end as split,
          concat('img_', cast(c_custkey % 60 as varchar(20))) as source,
          cast(c_custkey % 101 as double)/cast(100 as double) as confidence,
          case when c_custkey % 4 = 0 then 'negative' when c_custkey % 13 = 1 then null else 'positive' end as category,
          case when c_custkey % 8 = 0 then 'background' when c_custkey % 4 = 0 then 'other_text' else null end as subkind
        from {customer}""",
    "fx_history": """
        select s_nationkey as run_id, row_number() over (partition by s_nationkey order by s_suppkey) as epoch,
          case when s_suppkey % 9 = 0 then null else cast(s_suppkey * 37 % 50 as double)/cast(100 as double) end as val_cer
        from {supplier}""",
    "fx_frames": """
        select event_id as frame_id, user_id % 10 as camera_id, ts,
          case when event_id % 3 = 0 then 'engine_a' else 'engine_b' end as engine,
          concat('E300MM', lpad(cast(user_id * 7 % 1000 as varchar(20)), 6, '0')) as serial, value > 10 as matched
        from {events}""",
}
#: Parts of fixtures that the two engines write differently: (Spark, DuckDB).
BOTH = {
    # one 16 x 16 grey image for each vector; DuckDB multiplies a float by a whole number in single precision, Spark would in double
    "fx_pixels": (
        "select vec_id as image_id, y * 16 + x as i, x, y, cast(floor(abs(v) * cast(1000 as float)) as int) % 256 as v from {fx_cells}",
        """
        select vec_id as image_id, y * 16 + x as i, x, y, cast(floor(abs(v) * 1000) as int) % 256 as v from {fx_cells}"""),
    "fx_cells": (
        "select vec_id, x, y, embedding[(x * 7 + y * 3) % 64] as v from {embeddings} lateral view explode(sequence(0, 15)) as x lateral view explode(sequence(0, 15)) as y",
        "select vec_id, x, y, embedding[(x * 7 + y * 3) % 64 + 1] as v from {embeddings}, range(0, 16) a(x), range(0, 16) b(y)"),
    "fx_fixed": (
        "select vec_id, label, transform(sequence(0, 207), i -> cast(embedding[(i * 7) % 64] as double) * 20) as logits from {embeddings}",
        "select vec_id, label, list_transform(range(0, 208), lambda i: embedding[(i * 7) % 64 + 1]::double * 20) as logits from {embeddings}"),
    # scores that read a serial, with gaps and confidences that depend on the row
    "fx_reading": (
        "select vec_id, label, transform(sequence(0, 207), i -> case when i % 13 = case when floor(i / 13) > 11 then 12 else instr('0123456789EM', substr(s, cast(floor(i / 13) as int) + 1, 1)) - 1 end then 1.5D + label % 5 else cast((vec_id * 7 + i * 3) % 11 as double) / 8 end) as logits from (select o_orderkey as vec_id, o_custkey as label, concat(case when o_custkey % 6 = 0 then 'E103MM' else 'E300MM' end, lpad(cast(o_orderkey % 500 as varchar(20)), 6, '0')) as s from {orders})",
        "select vec_id, label, list_transform(range(0, 208), lambda i: case when i % 13 = case when i // 13 > 11 then 12 else instr('0123456789EM', s[(i // 13)::int + 1]) - 1 end then 1.5::double + label % 5 else ((vec_id * 7 + i * 3) % 11)::double / 8 end) as logits from (select o_orderkey as vec_id, o_custkey as label, concat(case when o_custkey % 6 = 0 then 'E103MM' else 'E300MM' end, lpad(cast(o_orderkey % 500 as varchar(20)), 6, '0')) as s from {orders})"),
    "fx_ctc": (
        "select vec_id, label, transform(sequence(0, 443), i -> cast(embedding[(i * 11) % 64] as double) * 20) as logits from {embeddings}",
        "select vec_id, label, list_transform(range(0, 444), lambda i: embedding[(i * 11) % 64 + 1]::double * 20) as logits from {embeddings}"),
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages")


def _filled(sql: str, side: int, table) -> str:
    def put(m: re.Match) -> str:
        name = m[1]
        if name in TABLES:
            return table(name)
        return f"({_filled(SQL[name] if name in SQL else BOTH[name][side], side, table)})" if name.startswith("fx_") else m[0]

    return re.sub(r"\{(\w+)\}", put, sql)


def duck(sql: str) -> str:
    """SQL for DuckDB, tables being views there."""
    return _filled(sql, 1, lambda t: t)


def spark_sql(spark: SparkSession, sf_dir: str, sql: str, by: Mapping[str, str] | None = None) -> DataFrame:
    """by: tables that are dealt out by a column first, without rows that have none.

    What works by that column above doesn't shuffle again, under whatever name it has there, and reads of the same columns share one shuffle.
    """
    by = by or {}

    def table(t: str) -> str:
        path = f"parquet.`{sf_dir}/{t}.parquet`"
        return f"(select /*+ repartition({by[t]}) */ * from {path} where {by[t]} is not null)" if t in by else path

    return spark.sql(_filled(sql, 0, table))


def fx(spark: SparkSession, sf_dir: str, name: str, by: Mapping[str, str] | None = None) -> DataFrame:
    return spark_sql(spark, sf_dir, f"select * from {{{name}}}", by)
