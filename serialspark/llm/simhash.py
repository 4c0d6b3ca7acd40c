"""SimHash near-duplicates by pivot distance tables.

A text's words are its runs outside ASCII white space, with A-Z lower-cased; its shingles are all runs of
three words. A fingerprint bit is set if it is set in over half the shingles' XXH64 (seed 42). Two
fingerprints link at ``radius`` or fewer differing bits.

Fingerprints that link agree on at least ``blocks - radius`` of ``blocks`` bit ranges, so each distinct
fingerprint is dealt to one bucket for every choice of that many ranges. Its Hamming distances to many reference
fingerprints (pivots) are computed once and stored as its row of the distance table, which goes along to the
buckets; by the triangle inequality a pair whose coordinates differ by over ``radius`` anywhere can't link and is
discarded; survivors are verified on the fingerprints. A task takes its buckets as a stream. Buckets beyond ``bucket_rows`` are cut into pieces that meet pairwise in tasks of their own.
Each task returns a spanning forest of its links, never all pairs.

Null texts count as empty: fingerprint zero. Rows with a null id get a fingerprint and no component.
Repeated ids and texts are grouped like any others; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType

from .common import join_counted, written
from .components import connected_components
from .near_copies import keep_first  # noqa: F401

SEED, SHINGLE, RADIUS, BLOCKS, PIVOTS, BUCKET_ROWS, HELD_ROWS = 42, 3, 3, 5, 48, 4096, 50_000


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    joined = b" ".join(words)
    if len(words) <= size:
        hashes = digest(joined, seed)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = b"".join([digest(joined[a:b], seed) for a, b in zip(starts[: 1 - size].tolist(), ends[size - 1 :].tolist(), strict=True)])
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(rows), 1 << 16):
        counts += np.unpackbits(rows[i : i + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(rows)).tobytes(), "big")


@F.pandas_udf(LongType())
def fingerprint_column(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The fingerprint's 64 bits as a signed long."""
    for batch in texts:
        yield pd.Series(np.fromiter((fingerprint(t) for t in batch), np.uint64, len(batch)).view(np.int64))


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints by rule: the XXH64 of each ordinal."""
    return np.array([xxhash.xxh64_intdigest(i.to_bytes(8, "little"), SEED) for i in range(n)], np.uint64)


def _table_column(n_pivots: int):
    """A function of a fingerprint column: its distances to the pivots, a byte each."""
    own = pivots(n_pivots)

    @F.pandas_udf(BinaryType())
    def table(fps: pd.Series) -> pd.Series:
        rows = np.bitwise_count(fps.to_numpy().view(np.uint64)[:, None] ^ own[None, :]).astype(np.int8)
        return pd.Series([r.tobytes() for r in rows], dtype=object)

    return table


def masks(blocks: int = BLOCKS, radius: int = RADIUS) -> list[int]:
    """One mask for every choice of blocks - radius of the bit ranges."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    ranges = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(ranges, blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def linked_in_buckets(bucket: np.ndarray, fp: np.ndarray, side: np.ndarray, radius: int, table: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links inside each bucket, as pairs of row numbers.

    side: 0 or 1 in a bucket of two pieces, of which only pairs across are wanted (2: no pieces). table: each row's distances to the pivots.
    """
    order = np.lexsort((table[:, 0], bucket))
    bucket, fp, side, table = bucket[order], fp[order], side[order], table[order]
    parent = np.arange(len(fp))
    forest: list[tuple[int, int]] = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    live, k = np.arange(len(fp)), 0
    while len(live):
        k += 1
        live = live[live + k < len(fp)]
        other = live + k
        near = (bucket[live] == bucket[other]) & (table[other, 0] - table[live, 0] <= radius)
        live, other = live[near], other[near]  # a row beyond the first coordinate's reach stays beyond it
        keep = (side[live] == 2) | (side[live] != side[other])
        a, b = live[keep], other[keep]
        for lo in range(1, table.shape[1], 8):
            if not len(a):
                break
            ok = (np.abs(table[a, lo : lo + 8] - table[b, lo : lo + 8]) <= radius).all(axis=1)
            a, b = a[ok], b[ok]
        ok = np.bitwise_count(fp[a] ^ fp[b]) <= radius
        a, b = a[ok], b[ok]
        apart = parent[a] != parent[b]
        for x, y in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
            p, q = root(x), root(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
                forest.append((int(order[x]), int(order[y])))
        if apart.any():
            parent = parent[parent]
    return forest


def links(nodes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, n_pivots: int = PIVOTS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges (a, b) that connect all fingerprints that link, from distinct (fp long, node long)."""
    spark = nodes.sparkSession
    cuts = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks(blocks, radius))])
    tabled = written(nodes.select("node", "fp", _table_column(n_pivots)("fp").alias("distances")), "pivot_table")
    keyed = tabled.select("node", "fp", "distances", F.inline(cuts))
    hot = keyed.groupBy("t", "key").count().where(F.col("count") > bucket_rows).select("t", "key", F.ceil(F.col("count") / bucket_rows).cast("int").alias("pieces"))
    hot = written(hot, "hot_buckets")
    piece = F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int")
    meet = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
    plain = keyed.join(hot, ["t", "key"], "left_anti").select("t", "key", F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(2).alias("side"), "node", "fp", "distances")
    cut = keyed.join(hot, ["t", "key"]).withColumn("piece", piece).withColumn("with", meet)
    cut = cut.select("t", "key", F.least("piece", "with").alias("p"), F.greatest("piece", "with").alias("q"), F.when(F.col("piece") == F.col("with"), 2).when(F.col("piece") < F.col("with"), 0).otherwise(1).alias("side"), "node", "fp", "distances")
    bucket_of = ["t", "key", "p", "q"]
    rows = plain.unionByName(cut).repartition(*bucket_of).sortWithinPartitions(*bucket_of)

    def linked(pdf: pd.DataFrame, bucket: np.ndarray) -> pd.DataFrame:
        many = np.bincount(bucket)[bucket] > 1
        pdf, bucket = pdf[many], bucket[many]
        table = np.frombuffer(b"".join(pdf["distances"]), np.int8).reshape(len(pdf), n_pivots)
        forest = linked_in_buckets(bucket, pdf["fp"].to_numpy().view(np.uint64), pdf["side"].to_numpy(), radius, table)
        pairs, node = np.array(forest, np.int64).reshape(-1, 2), pdf["node"].to_numpy()
        return pd.DataFrame({"a": node[pairs[:, 0]], "b": node[pairs[:, 1]]})

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            held.append(pdf)
            if sum(map(len, held)) >= HELD_ROWS:  # all buckets but the last are whole
                pdf = pd.concat(held, ignore_index=True)
                bucket = _numbered(pdf[bucket_of])
                open_ = bucket == bucket[-1]
                held = [pdf[open_]]
                yield linked(pdf[~open_], bucket[~open_])
        if held:
            pdf = pd.concat(held, ignore_index=True)
            yield linked(pdf, _numbered(pdf[bucket_of]))

    return rows.mapInPandas(find, "a long, b long")


def _numbered(keys: pd.DataFrame) -> np.ndarray:
    """A number for each run of equal rows."""
    rows = keys.to_numpy()
    return np.cumsum(np.concatenate(([0], (rows[1:] != rows[:-1]).any(axis=1).astype(np.int64)))) if len(rows) else np.zeros(0, np.int64)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; component_id is the smallest id reachable."""
    fps = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint_column(F.col(text_col).cast("string")).alias("fp")), "fingerprints")
    nodes = written(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")), "nodes")
    # an id that stands under two texts joins their groups
    twice = fps.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("f1"), F.max("fp").alias("f2"), F.count_distinct("fp").alias("n")).where("n > 1")
    twice = fps.join(twice.select("doc_id"), "doc_id", "left_semi").join(nodes.select("fp", "node"), "fp").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    edges = links(nodes.select("fp", "node"), radius, bucket_rows=bucket_rows).unionByName(twice)
    found = connected_components(edges)
    named = written(nodes.join(found, "node", "left").select("fp", "n", F.coalesce("component", "node").alias("component_id")), "components")
    out = join_counted(fps, named, "fp", "n")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
