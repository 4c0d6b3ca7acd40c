"""Token counts by a separator scan over flat token files without an index.

A token file is a run of unsigned 16-bit ids; each document ends in a separator id. It is stored as blocks
of a fixed number of tokens, whose edges know nothing of documents. Each block is searched for separators
with numpy; a prefix scan over the blocks' totals (first within stretches of blocks, then over stretches)
gives every block its place and the last separator before it, which stitches documents that cross edges.

Null and empty texts are documents of no tokens. Tokens after a file's last separator are a document of
their own. Repeated rows count each. An empty table gives an empty one.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

BLOCK_TOKENS, STRETCH = 1 << 19, 256
BLOCKS = "kind string, file_id long, block_no long, data binary, doc_ids array<long>"


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file of lines "base64 token, rank"."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


def write_token_files(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Tokenises documents into one flat file a partition. Returns (blocks, ids of each file's documents in order).

    The separator is the first id beyond the vocabulary, which must fit 16 bits.
    """
    spark = docs.sparkSession
    separator = len(ranks)
    if separator > 0xFFFF:
        raise ValueError("the vocabulary doesn't fit 16 bits")
    shared = spark.sparkContext.broadcast((ranks, pattern))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks, pattern = shared.value
        codec = tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        file_id, block_no, held, size, ids = TaskContext.get().partitionId(), 0, [], 0, []
        row = lambda kind, no, data, ids: pd.DataFrame({"kind": [kind], "file_id": [file_id], "block_no": [no], "data": [data], "doc_ids": [ids]})
        no_ids = 0
        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                tokens = np.array([*(codec.encode_ordinary(text) if text else ()), separator], "<u2")
                held.append(tokens)
                size += len(tokens)
                ids.append(None if pd.isna(doc_id) else int(doc_id))
                if size >= block_tokens:
                    flat = np.concatenate(held)
                    for i in range(0, size - block_tokens + 1, block_tokens):
                        yield row("tokens", block_no, flat[i : i + block_tokens].tobytes(), None)
                        block_no += 1
                    held = [flat[size - size % block_tokens :]]
                    size %= block_tokens
            if len(ids) >= 100_000:
                yield row("ids", no_ids, None, ids)
                no_ids, ids = no_ids + 1, []
        if size:
            yield row("tokens", block_no, np.concatenate(held).tobytes(), None)
        if ids:
            yield row("ids", no_ids, None, ids)

    table = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInPandas(pack, BLOCKS), "token_files", "kind")
    return table.where("kind = 'tokens'").select("file_id", "block_no", "data"), table.where("kind = 'ids'").select("file_id", "block_no", "doc_ids")


def scan(blocks: DataFrame, separator: int, stretch: int = STRETCH) -> DataFrame:
    """(file_id, doc_no, start_token, n_tokens) of every document in files given as (file_id, block_no, data)."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            data = [np.frombuffer(d, "<u2") for d in pdf["data"]]
            yield pd.DataFrame({"file_id": pdf["file_id"], "block_no": pdf["block_no"], "n": [len(d) for d in data], "at": [np.flatnonzero(d == separator) for d in data]})

    found = written(blocks.mapInPandas(search, "file_id long, block_no long, n long, at array<long>"), "separators")
    found = found.withColumn("part", F.floor(F.col("block_no") / stretch)).withColumn("seps", F.size("at").cast("long"))
    inner = Window.partitionBy("file_id", "part").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    near = found.withColumn("base", F.coalesce(F.sum("n").over(inner), F.lit(0))).withColumn("doc_base", F.coalesce(F.sum("seps").over(inner), F.lit(0)))
    near = near.withColumn("own_last", F.when(F.col("seps") > 0, F.col("base") + F.array_max("at")))
    near = near.withColumn("last", F.max("own_last").over(inner))
    parts = near.groupBy("file_id", "part").agg(F.sum("n").alias("n"), F.sum("seps").alias("seps"), F.max("own_last").alias("own_last"))
    outer = Window.partitionBy("file_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("part_base", F.coalesce(F.sum("n").over(outer), F.lit(0))).withColumn("part_docs", F.coalesce(F.sum("seps").over(outer), F.lit(0)))
    parts = parts.withColumn("part_end", F.col("part_base") + F.col("own_last")).withColumn("part_last", F.max("part_end").over(outer))
    joined = near.select("file_id", "part", "at", "base", "doc_base", "last").join(parts.select("file_id", "part", "part_base", "part_docs", "part_last"), ["file_id", "part"])
    place = F.col("part_base") + F.col("base")
    before = F.coalesce(F.col("part_base") + F.col("last"), F.col("part_last"), F.lit(-1))
    ends = joined.select("file_id", (F.col("part_docs") + F.col("doc_base")).alias("doc_base"), before.alias("before"), F.transform("at", lambda x: x + place).alias("ends"))
    docs = ends.where(F.size("ends") > 0).select("file_id", "doc_base", F.posexplode(F.arrays_zip("ends", F.concat(F.array("before"), F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0)))).alias("starts"))).alias("i", "d"))
    docs = docs.select("file_id", (F.col("doc_base") + F.col("i")).alias("doc_no"), (F.col("d.starts") + 1).alias("start_token"), (F.col("d.ends") - F.col("d.starts") - 1).alias("n_tokens"))
    whole = parts.groupBy("file_id").agg(F.sum("n").alias("n"), F.sum("seps").alias("doc_no"), F.coalesce(F.max("part_end") + 1, F.lit(0)).alias("start_token"))
    rest = whole.where("n > start_token").select("file_id", "doc_no", "start_token", (F.col("n") - F.col("start_token")).alias("n_tokens"))
    return docs.unionByName(rest)


def counts(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, file_id, start_token, n_tokens) of every row, by way of token files."""
    blocks, ids = write_token_files(docs, ranks, pattern, id_col, text_col, block_tokens)
    scanned = scan(blocks, len(ranks))
    named = ids.select("file_id", "block_no", F.posexplode("doc_ids").alias("i", "doc_id"))
    first = Window.partitionBy("file_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    base = ids.select("file_id", "block_no", F.coalesce(F.sum(F.size("doc_ids").cast("long")).over(first), F.lit(0)).alias("base"))
    named = named.join(base, ["file_id", "block_no"]).select("file_id", (F.col("base") + F.col("i")).alias("doc_no"), "doc_id")
    return scanned.join(named, ["file_id", "doc_no"]).select("doc_id", "file_id", "start_token", "n_tokens")


def read_flat_files(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks (file_id, block_no, data) of flat files of unsigned 16-bit ids; a file must fit one row of Spark's binary reader."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file_id, data in zip(pdf["file_id"], pdf["content"], strict=True):
                step = 2 * block_tokens
                for no, i in enumerate(range(0, len(data), step)):
                    yield pd.DataFrame({"file_id": [file_id], "block_no": [no], "data": [data[i : i + step]]})

    files = spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("file_id"), "content")
    return files.mapInPandas(cut, "file_id long, block_no long, data binary")
