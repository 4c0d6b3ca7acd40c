"""What the operators of this package share: the shared folder, tables that cut lineage, batches."""

from __future__ import annotations

import sys
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class _Letters(dict):
    """A table for str.translate that keeps letters and makes spaces of all else; filled as characters come up."""

    def __missing__(self, c: int) -> int:
        self[c] = c if chr(c).isalpha() else 32
        return self[c]


_LETTERS = _Letters()


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased. Digits, fractions and other numerals are no letters."""
    return text.lower().translate(_LETTERS).split() if text else []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for all executors. On a local master a temporary one serves where none is set; elsewhere that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_tables: list[str] = []  # written by this driver and not yet dropped


def new_path(spark: SparkSession, name: str) -> str:
    """A place in the shared folder that drop_tables will delete."""
    _tables.append(f"{shared_dir(spark)}/serialspark/{name}-{uuid.uuid4().hex}")
    return _tables[-1]


def written(df: DataFrame, name: str, *partition_by: str, codec: str = "zstd") -> DataFrame:
    """Writes df as a table in the shared folder and reads it back, so later steps don't compute it again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", codec)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables on the way to one result, deleted one by one or all at the end of a with block; other threads' tables aren't touched."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def written(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = f"{shared_dir(self.spark)}/serialspark/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables written here whose readers are all stored."""
        for df in tables:
            delete(self.spark, self.paths.pop(id(df))[1])

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*[df for df, _ in self.paths.values()])


def mark_tables() -> int:
    """A mark for drop_tables: what is written from here on."""
    return len(_tables)


def drop_tables(spark: SparkSession, since: int = 0) -> int:
    """Deletes the intermediate tables written since the mark; results that were not stored before can't be read any more. Returns how many."""
    gone = _tables[since:]
    del _tables[since:]
    for path in gone:
        delete(spark, path)
    return len(gone)


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def join_counted(big: DataFrame, small: DataFrame, key: str, n: str) -> DataFrame:
    """big left-joined with small (one row a key; n: how many rows of big have it; n is dropped), with hot keys taken out of the shuffle.

    Keys that hold over a thousandth of the rows counted (and over 10,000 rows) are fewer than a thousand, so they are
    broadcast; all others are joined by a shuffle in which no key is hot. big is read twice where there are hot keys.
    """
    total = small.agg(F.sum(n)).first()[0] or 0
    least = max(10_000, total // 1000)
    hot = F.broadcast(small.where(F.col(n) > least).drop(n))
    rest = small.where(F.col(n) <= least).drop(n)
    if hot.isEmpty():
        return big.join(rest, key, "left")
    return big.join(hot, key).unionByName(big.join(hot.select(key), key, "left_anti").join(rest, key, "left"))


MOST_BITS = 1 << 26


def sifted(rows: DataFrame, ids: DataFrame, id_col: str, maybe: str, kind: str = "long") -> DataFrame:
    """rows with a column maybe: false only where the id is none of ids (id_col); of others it is true for a share of at most about a sixteenth.

    The ids' hashes set bits, 16 for each id but at most ``MOST_BITS`` of all, so what is broadcast is at most a
    million words; with more ids than that more rows pass. So rows need no shuffle to be parted from most of those that no id means.
    """
    bits = min(MOST_BITS, max(1 << 12, 1 << (16 * ids.count()).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(F.col(f"`{c}`").cast(kind)), F.lit(bits))
    word, mask = free_name(rows, "_word"), free_name(rows, "_mask")
    words = ids.where(F.col(id_col).isNotNull()).select(place(id_col).alias("at")).groupBy(F.expr("at div 64").alias(word)).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias(mask))
    hit = F.coalesce(F.getbit(F.col(mask), (place(id_col) % 64).cast("int")) == 1, F.lit(False))
    key = F.floor(place(id_col) / 64)
    return rows.join(F.broadcast(words), key == F.col(word), "left").withColumn(maybe, hit).drop(word, mask)


def id_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, mod n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have, in any letter case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def chunks(texts, most: int, rows: int = sys.maxsize):
    """(start, end) of runs of at most so many texts with at most so many characters, one text at least."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if isinstance(t, (str, bytes)) else 0
        if i > start and (size + n > most or i - start >= rows):
            yield start, i
            start, size = i, 0
        size += n
    if len(texts) > start:
        yield start, len(texts)


def gathered(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start .. start + size - 1 of each row, one after the other."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)
