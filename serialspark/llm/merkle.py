"""A Merkle manifest of a dataset: a tree for each source, a tree over the sources, and a proof for each row.

A leaf is the SHA-256 of a row's columns, each as ``-`` if null, else its UTF-8 byte count, a colon and its value. In a
tree, leaves ascend by their order columns; while several nodes remain, every ``ARITY`` consecutive ones become the
SHA-256 of their digests in hexadecimal (the last run may be shorter, and even of one). The roots of the sources'
trees, null first and then by UTF-8 bytes, are the leaves of the last tree.

A tree is stored as an append log in postorder: a node is written as soon as its last child is. Builders work on
aligned blocks of ``ARITY ** LEVELS`` leaves, so each writes the nodes of its own subtrees in completion order, as one
row, without hearing of others; the blocks' roots are the leaves of the next round's log. Where a node stands in its
log follows from the sizes of the subtrees before it, so a proof reads its siblings at computed places.

Leaves get their places from a range partitioning by tree and order: each partition counts its rows of each tree, and
running sums of these few counts say where each run begins. So a source may hold any share of the rows.

Null ids come first. Rows of equal ids are ordered by their leaves; rows that repeat each other are leaves of their own.
An empty table gives an empty manifest. A null text counts as ``-``, an empty one as ``0:``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

ARITY, LEVELS = 16, 2
BLOCK = ARITY**LEVELS
HASH = 32  # bytes
TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
SEGMENT = "tree string, block long, n long, height int, digests binary, root string, ids array<long>, others array<string>"


def as_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows as an Arrow batch of "name type, name type"."""
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, TYPES[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def field(column: Column) -> Column:
    """A value as it enters a leaf."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*columns: Column) -> Column:
    """The digest of a row's columns."""
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def position(index: int, level: int, n: int) -> int:
    """Where the node of that level and index stands in the postorder log of a tree of n leaves: behind its last leaf and the nodes that end with it."""
    last, before = min((index + 1) * ARITY**level, n) - 1, 0
    runs = last
    while runs:
        before += runs
        runs //= ARITY
    return before + level


def height_of(n: int) -> int:
    """Levels above n leaves."""
    found = 0
    while n > 1:
        n, found = -(-n // ARITY), found + 1
    return found


def log_of(leaves: list[str], height: int) -> bytes:
    """The nodes above some leaves, up to that height, in completion order."""
    out, open_runs = [], [[] for _ in range(height + 1)]
    for i, digest in enumerate(leaves):
        level, last = 0, i == len(leaves) - 1
        while True:
            out.append(digest)
            open_runs[level].append(digest)
            if level == height or not (last or len(open_runs[level]) == ARITY):
                break
            digest = hashlib.sha256("".join(open_runs[level]).encode()).hexdigest()
            open_runs[level] = []
            level += 1
    return bytes.fromhex("".join(out))


def siblings_of(digests: bytes, n: int, height: int, index: int) -> tuple[list[str], list[str]]:
    """For each level from a leaf up, the digests in its run to the left of its node, and to the right, in hexadecimal."""
    read = lambda level, lo, hi: "".join(digests[HASH * (at := position(j, level, n)) : HASH * (at + 1)].hex() for j in range(lo, hi))
    before, after, wide = [], [], n
    for level in range(height):
        first = index - index % ARITY
        before.append(read(level, first, index))
        after.append(read(level, index + 1, min(first + ARITY, wide)))
        index, wide = index // ARITY, -(-wide // ARITY)
    return before, after


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows (tree, ...) with idx, their places in their trees by the order columns, and total, the trees' sizes."""
    spread = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("part", F.spark_partition_id())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, n = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column("tree").to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            at = np.arange(len(own)) - np.repeat(first, np.diff(np.r_[first, len(own)]))
            if own[0] == tree:
                at[: first[1] if len(first) > 1 else None] += n
            tree, n = own[-1], int(at[-1]) + 1
            yield batch.append_column("at", pa.array(at))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spread.schema.fields)
    spread = written(spread.mapInArrow(count, f"{schema}, at long"), "merkle_order")
    counts = spread.groupBy("tree", "part").agg((F.max("at") + 1).alias("rows"))
    own, all_rows = Window.partitionBy("tree").orderBy("part"), Window.partitionBy("tree")
    counts = counts.withColumn("total", F.sum("rows").over(all_rows)).withColumn("offset", F.sum("rows").over(own) - F.col("rows"))
    return spread.join(counts.drop("rows"), ["tree", "part"]).withColumn("idx", F.col("at") + F.col("offset")).drop("part", "at", "offset")


def _built(nodes: DataFrame) -> DataFrame:
    """One row of the log for each aligned block of nodes (tree, idx, total, digest, id, other)."""
    placed = nodes.withColumn("block", F.floor(F.col("idx") / BLOCK)).select("tree", "block", "idx", "total", "digest", "id", "other")
    placed = placed.repartition("tree", "block").sortWithinPartitions("tree", "block", "idx")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(block: list[tuple]) -> tuple:
            tree, no, _, total, *_ = block[0]
            height = LEVELS if total > BLOCK else height_of(total)
            digests = log_of([x[4] for x in block], height)
            return tree, no, len(block), height, digests, digests[-HASH:].hex(), [x[5] for x in block], [x[6] for x in block]

        held: list[tuple] = []
        for batch in batches:
            out = []
            for own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][:2] != own[:2]:
                    out.append(row(held))
                    held = []
                held.append(own)
            yield as_batch(out, SEGMENT)
        if held:
            yield as_batch([row(held)], SEGMENT)

    return placed.mapInArrow(build, SEGMENT)


def append_logs(leaves: DataFrame) -> list[DataFrame]:
    """The log of leaves (tree, idx, total, digest, id, other), then that of its blocks' roots, and so on until each tree is one block."""
    logs, nodes = [], leaves
    while True:
        logs.append(written(_built(nodes), "merkle_log"))
        many = logs[-1].groupBy("tree").agg(F.count("*").alias("total")).where("total > 1")
        if many.isEmpty():
            return logs
        none = [F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("other")]
        nodes = logs[-1].join(many, "tree").select("tree", F.col("block").alias("idx"), "total", F.col("root").alias("digest"), *none)


def roots_of(logs: list[DataFrame]) -> DataFrame:
    """(tree, root) of each tree: of the last block left of it."""
    found = None
    for log in logs:
        own = log.join(log.groupBy("tree").agg(F.count("*").alias("blocks")).where("blocks = 1"), "tree").select("tree", "root")
        found = own if found is None else found.unionByName(own)
    return found


PATH = "before array<string>, after array<string>"


def paths(logs: list[DataFrame], above: DataFrame) -> DataFrame:
    """(tree, idx, id, digest, other, before, after) of each leaf: its siblings level by level, those in above (tree, before, after) at last."""
    schema = f"tree string, idx long, id long, digest string, other string, {PATH}"

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, block, n, height, digests, ids, others, before, after in zip(*(batch.column(c).to_pylist() for c in ("tree", "block", "n", "height", "digests", "ids", "others", "before", "after")), strict=True):
                out = []
                for i in range(n):
                    left, right = siblings_of(digests, n, height, i)
                    at = HASH * position(i, 0, n)
                    out.append((tree, block * BLOCK + i, ids[i], digests[at : at + HASH].hex(), others[i], left + before, right + after))
                yield as_batch(out, schema)

    upper = None  # paths of the blocks of the log below
    for log in reversed(logs):
        last = log.join(log.groupBy("tree").agg(F.count("*").alias("blocks")).where("blocks = 1").select("tree"), "tree").join(above, "tree")
        if upper is not None:
            rest = log.join(upper.select("tree", F.col("idx").alias("block"), "before", "after"), ["tree", "block"])
            last = last.select(*rest.columns).unionByName(rest)
        upper = last.mapInArrow(extract, schema)
        if log is not logs[0]:
            upper = written(upper, "merkle_paths")
    return upper


def folded(start: Column, before: Column, after: Column) -> Column:
    """The root that a leaf and its siblings make."""
    steps = F.zip_with(before, after, lambda b, a: F.struct(b.alias("before"), a.alias("after")))
    return F.aggregate(steps, start, lambda x, p: F.sha2(F.concat(p["before"], x, p["after"]), 256))


def siblings_digest(before: Column, after: Column) -> Column:
    """The digest of all siblings, level by level and from left to right."""
    return F.sha2(F.array_join(F.zip_with(before, after, lambda b, a: F.concat(b, a)), ""), 256)


def manifest(rows: DataFrame, columns: list[Column], tree: Column, id_col: Column, other: Column | None = None) -> DataFrame:
    """(tree, id, leaf, other, subroot, root, before, after) of every row.

    columns: what a leaf is made of, in order. tree: the key of a row's tree, as text. other: a digest that goes with
    the row, such as the leaf of a later copy, to be folded with the row's siblings.
    """
    key = F.coalesce(F.concat(F.lit("="), tree.cast("string")), F.lit("-"))  # in the order of the trees, null first
    own = rows.select(key.alias("tree"), id_col.cast("long").alias("id"), leaf(*columns).alias("digest"), (F.lit(None).cast("string") if other is None else other).alias("other"))
    logs = append_logs(numbered(written(own, "merkle_leaves"), "id", "digest"))
    subroots = written(roots_of(logs), "merkle_roots")
    none = [F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("other")]
    order = numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest")), "name")
    top = append_logs(order.select("tree", "idx", "total", "digest", *none))
    root = roots_of(top).first()
    places = order.select("idx", F.col("name").alias("tree"), F.col("digest").alias("subroot"))
    empty = rows.sparkSession.createDataFrame([("", [], [])], f"tree string, {PATH}")
    above = written(paths(top, empty).select("idx", "before", "after").join(places, "idx").drop("idx"), "merkle_tops")
    found = paths(logs, above.select("tree", "before", "after")).join(above.select("tree", "subroot"), "tree")
    return found.select(F.expr("nullif(tree, '-')").substr(F.lit(2), F.lit(1 << 30)).alias("tree"), "id", F.col("digest").alias("leaf"), "other", "subroot", F.lit(root["root"] if root else None).cast("string").alias("root"), "before", "after")
