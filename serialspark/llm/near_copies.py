"""Near copies by SimHash, tables of pivot distances and exact Jaccard similarity of word shingles.

A text's words are its runs outside ASCII white space, with A-Z lower-cased; its shingles are the different
runs of ``size`` words, or all its words if it has fewer, by 64-bit hashes. Two texts are near copies if their
shingles' Jaccard similarity is at least ``similarity``; near copies of near copies form one group.

Texts of the same words are one node, named by the smallest id that has them. A node's fingerprint has ``BITS`` bits, of which
each is set if it is set in over half the shingles' hashes for it. Sets of similarity s differ in a share of acos(2 s / (1 + s)) / pi
of the bits (0.1515 at 0.8), small ones in up to ``SPREAD`` times that, and those of up to five shingles in up to ``TINY_SPREAD`` times.

1. Buckets by ``BANDS`` ranges of ``ROWS`` equal bits bring nodes together: at 0.8 all but 1 in 100,000 pairs, of small ones 1 in 17,000, of up to five shingles 1 in 900.
2. The table of pivot distances, stored once for each node and dealt to the buckets, discards. Pivots are compared
   in small ranges, since distances to whole ones hardly vary: of each two of the first ``TABLE_BITS`` bits the table holds the
   distance to a pivot's two bits (0, 1 or 2, as that many set bits). By the triangle inequality in each range a pair differs in at least the sum of its
   coordinates' differences. A pair stays if that is at most ``SIGMAS`` deviations above what pairs at the similarity differ in.
3. Whole fingerprints are compared in the same way, in the bucket of the first range that a pair shares and in no other.
4. What is left is compared exactly: only nodes of such pairs have their shingles dealt, in rows of at most ``DEALT``.

The first ``FIRST_BANDS`` ranges go first; of the others only pairs of different groups found until then are looked
at. Large buckets are cut into pieces that meet pairwise: beyond ``MEET_ROWS * bucket_rows`` nodes in step 2, beyond ``bucket_rows`` nodes or
``BUCKET_SHINGLES`` shingles in steps 3 and 4. Of each bucket a spanning forest is kept, never all pairs.

Null texts count as empty, and empty ones as copies of each other. An empty table gives an empty one. What is written on the
way is deleted as soon as the next table is stored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .common import Scratch, free_name, sifted, written
from .components import connected_components
from .flat import hashes_of, joined, texts_of, words_of

SEED, SIZE, SIMILARITY, BANDS, ROWS, FIRST_BANDS, BUCKET_ROWS, BUCKET_SHINGLES, DEALT, BATCH_BYTES = 42, 5, 0.8, 64, 11, 4, 1024, 2_000_000, 512, 400_000
BITS, TABLE_BITS, MEET_ROWS, HELD_ROWS = BANDS * ROWS, 256, 16, 50_000
SIGMAS, SPREAD, TINY, TINY_SPREAD = 4.5, 1.07, 5, 1.24  # the spreads were counted for all sizes below 120
_RANDOM = np.random.default_rng(SEED)
_MASK, _FACTOR = _RANDOM.integers(0, 1 << 64, BITS // 64, np.uint64), _RANDOM.integers(0, 1 << 63, BITS // 64, np.uint64) * np.uint64(2) + np.uint64(1)
_PIVOTS = _RANDOM.integers(0, 2, TABLE_BITS, np.uint8)
_PLACE = _RANDOM.integers(0, 1 << 63, 4096, np.uint64) * np.uint64(2) + np.uint64(1)
_IS_WORD = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])


def digest_of(words: bytes) -> bytes:
    """Of words joined by one space each."""
    return xxhash.xxh3_128_digest(words)


def shingles(words: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The different shingles' hashes, rising, from the words' hashes."""
    if not len(words):
        return np.zeros(0, np.uint64)
    n = min(size, len(words))
    own = words.view(np.uint64)
    total = np.full(len(own) - n + 1, n, np.uint64)
    for k in range(n):
        total += own[k : len(own) - n + 1 + k] * _PLACE[k]
    total = (total ^ (total >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return np.unique(total ^ (total >> np.uint64(32)))


def bits_of(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of a set of hashes, a byte each bit."""
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 255):
        h = (hashes[i : i + 255, None] ^ _MASK) * _FACTOR
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        counts += np.unpackbits(h.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return (counts * 2 > len(hashes)).astype(np.uint8)


minima_of = bits_of  # the name that an older test has for what signatures are made of


def pivot_distances(bits: np.ndarray) -> bytes:
    """Of each two of the first bits the distance to the pivot's two, as that many set bits."""
    a, b = (bits[:TABLE_BITS] ^ _PIVOTS).reshape(-1, 2).T
    return np.packbits(np.stack([a | b, a & b], axis=1).ravel()).tobytes()


def texts_words(column: pa.Array) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """(row, its words joined by one space, their hashes) of each text."""
    for lo, _, data, offsets in texts_of(column, BATCH_BYTES):
        words = joined(words_of(data, offsets, _IS_WORD))
        h, all_bytes = hashes_of(words), words.data.tobytes()
        for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
            yield lo + i, all_bytes[words.start[a] : words.end[b - 1]] if b > a else b"", h[a:b]


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, digest, n, keys, distances, sign) of docs (doc_id, text)."""
    places = 1 << np.arange(ROWS)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, text, words in texts_words(batch.column(1)):
                own = shingles(words, size)
                bits = bits_of(own)
                keys = (bits.reshape(BANDS, ROWS) @ places).astype(np.int16) if len(own) else np.zeros(0, np.int16)
                rows.append((digest_of(text), len(own), keys, pivot_distances(bits), np.packbits(bits).tobytes()))
            columns = zip(*rows, strict=True) if rows else [()] * 5
            types = [pa.binary(), pa.int32(), pa.list_(pa.int16()), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, types, strict=True))], ["doc_id", "digest", "n", "keys", "distances", "sign"])

    return docs.select("doc_id", "text").mapInArrow(sketch, "doc_id long, digest binary, n int, keys array<smallint>, distances binary, sign binary")


def _dealt(texts: DataFrame, size: int) -> DataFrame:
    """(node, c, shingles) of (node, digest, text), in rows of at most DEALT; texts of other words than the node's are left out."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, digests, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for i, text, words in texts_words(batch.column(2)):
                if digest_of(text) == digests[i]:
                    found = shingles(words, size).view(np.int64)
                    rows += [(nodes[i], k // DEALT, found[k : k + DEALT]) for k in range(0, len(found), DEALT)]
                if len(rows) >= 2000:
                    yield out(rows)
                    rows = []
            yield out(rows)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        node, c, own = zip(*rows, strict=True) if rows else [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(c, pa.int32()), pa.array(own, pa.list_(pa.int64()))], ["node", "c", "shingles"])

    return texts.select("node", "digest", "text").mapInArrow(deal, "node long, c int, shingles array<long>")


@F.pandas_udf(BinaryType())
def digest_column(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Equal for texts of the same words."""
    for texts in batches:
        yield pd.Series([digest_of(text) for _, text, _ in texts_words(pa.array(texts, pa.large_string()))], dtype=object)


def most_apart(bits: int, similarity: float, spread: float = SPREAD) -> float:
    """In how many of so many bits a pair of that similarity differs at most, but for a few in a million."""
    share = min(0.5, spread * math.acos(2 * similarity / (1 + similarity)) / math.pi)
    return bits * share + SIGMAS * math.sqrt(bits * share * (1 - share))


def least_agreeing(similarity: float) -> float:
    """In how many bits the fingerprints of a pair of that similarity agree at least."""
    return BITS - most_apart(BITS, similarity)


def plausible(i: int, after: np.ndarray, signs: np.ndarray, n: np.ndarray, band: int, similarity: float) -> np.ndarray:
    """Of the rows in after, those whose fingerprint may be that of a near copy of row i and that share no earlier band with it."""
    apart = signs[after] ^ signs[i]
    some = np.bitwise_count(apart).sum(axis=1) <= most_apart(BITS, similarity, TINY_SPREAD if n[i] <= TINY else SPREAD)
    after, apart = after[some], apart[some]
    bands = ~np.unpackbits(apart, axis=1).reshape(-1, BANDS, ROWS).any(axis=2)
    return after[bands.argmax(axis=1) == band]


def kept_by_pivots(bucket: np.ndarray, n: np.ndarray, group: np.ndarray, side: np.ndarray, table: np.ndarray, similarity: float) -> np.ndarray:
    """Which rows have another one in their bucket, of another group, that their sizes and pivot distances don't discard; rows are sorted by bucket and n."""
    wanted, live, k = np.zeros(len(n), bool), np.arange(len(n)), 0
    most = np.where(n <= TINY, most_apart(TABLE_BITS, similarity, TINY_SPREAD), most_apart(TABLE_BITS, similarity)).astype(np.uint16)
    words, cut, largest = np.ascontiguousarray(table.T), (side != 2).any(), np.floor(n / similarity + 1e-9).astype(n.dtype)
    while len(live):
        k += 1
        live = live[live + k < len(n)]
        live = live[(bucket[live] == bucket[live + k]) & (n[live + k] <= largest[live])]  # a row too large stays too large
        a, b = live, live + k
        apart = np.zeros(len(a), np.uint16)
        for word in words:
            apart += np.bitwise_count(word[a] ^ word[b])
        near = apart <= most[a]
        a, b = a[near], b[near]
        near = group[a] != group[b]
        if cut:
            near &= (side[a] == 2) | (side[a] != side[b])
        wanted[a[near]] = wanted[b[near]] = True
    return wanted


def forest_of(sets: list[np.ndarray], side: np.ndarray, similarity: float, known: np.ndarray | None = None, near: Callable[[int, np.ndarray], np.ndarray] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the similar pairs, as pairs of row numbers; rows of one known group aren't compared.

    side: 0 or 1 in a bucket of two pieces, of which only pairs across are wanted (2: no pieces). near: of a row and
    later ones, those that are compared.
    """
    size = np.array([len(s) for s in sets])
    flat, start = np.concatenate(sets), np.cumsum(size) - size
    group, forest = np.arange(len(sets)) if known is None else np.unique(known, return_inverse=True)[1], []
    for i in range(len(sets) - 1):
        small, large = np.minimum(size[i], size[i + 1 :]), np.maximum(size[i], size[i + 1 :])
        other = i + 1 + np.flatnonzero((group[i + 1 :] != group[i]) & ((side[i + 1 :] == 2) | (side[i + 1 :] != side[i])) & (small >= similarity * large - 1e-9))
        other = other if near is None else near(i, other)
        if not len(other):
            continue
        n = size[other]
        first = np.cumsum(n) - n
        own = flat[np.repeat(start[other] - first, n) + np.arange(n.sum())]
        at = np.minimum(np.searchsorted(sets[i], own), size[i] - 1)
        shared = np.add.reduceat((sets[i][at] == own).astype(np.int64), first)
        for j in other[shared * (1 + similarity) >= similarity * (size[i] + n) - 1e-9].tolist():
            if group[i] != group[j]:
                group[group == group[j]] = group[i]
                forest.append((i, j))
    return forest


def links(nodes: DataFrame, docs: DataFrame, size: int = SIZE, similarity: float = SIMILARITY, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges (a, b) of nodes that connect all near copies found, from distinct (node, digest, n, keys, distances, sign, doc_id) and docs (doc_id, text)."""
    edges = None
    for lo, hi in ((0, FIRST_BANDS), (FIRST_BANDS, BANDS)):
        with Scratch(nodes.sparkSession) as scratch:
            table = nodes.select("node", "n", "distances", F.slice("keys", lo + 1, hi - lo).alias("keys"))
            if edges is None:
                table = table.withColumn("group", F.col("node"))
            else:
                groups = connected_components(edges).select("node", F.col("component").alias("group"))
                table = table.join(groups, "node", "left").withColumn("group", F.coalesce("group", "node"))
            table = scratch.written(table, "pivot_table")
            keyed = scratch.written(_met_by_pivots(table, lo, similarity, MEET_ROWS * bucket_rows), "band_keys")
            found = written(_links_in_bands(keyed, nodes, docs, size, similarity, bucket_rows, scratch), "near_links")
        edges = found if edges is None else edges.unionByName(found)
    return edges


BUCKET = ("t", "key", "p", "q")


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """(bucket, its rows' other values) of rows sorted by BUCKET, which stands first; a bucket may go on over batches."""
    at, held = None, []
    for batch in batches:
        for t, key, p, q, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (t, key, p, q) != at:
                if held:
                    yield at, held
                at, held = (t, key, p, q), []
            held.append(row)
    if held:
        yield at, held


def _cut(rows: DataFrame) -> DataFrame:
    """Rows of buckets (t, key) with their pieces, dealt to the pairs of pieces (p, q) that meet; side tells the piece, 2 where a piece meets itself."""
    rows = rows.withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    side = F.when(F.col("piece") == F.col("with"), 2).when(F.col("piece") < F.col("with"), 0).otherwise(1)
    return rows.select("*", F.least("piece", "with").alias("p"), F.greatest("piece", "with").alias("q"), side.alias("side")).drop("piece", "with", "pieces")


def _met_by_pivots(table: DataFrame, lo: int, similarity: float, meet_rows: int) -> DataFrame:
    """(t, key, node, n, group) of rows of the table (node, n, distances, keys from band lo on, group) that share a key with a row of another group that pivots don't discard."""
    rows = table.select("node", "n", "group", "distances", F.posexplode("keys").alias("t", "key")).withColumn("t", F.col("t") + lo)
    rows = rows.withColumn("key", F.col("key").cast("int"))
    large = rows.groupBy("t", "key").agg(F.count("*").alias("rows")).where(F.col("rows") > meet_rows)
    large = written(large.select("t", "key", F.ceil(F.col("rows") / meet_rows).cast("int").alias("pieces")), "large_buckets")
    whole = rows.withColumn("p", F.lit(0)).withColumn("q", F.lit(0)).withColumn("side", F.lit(2))
    if cut := not large.isEmpty():
        whole = whole.join(F.broadcast(large.select("t", "key")), ["t", "key"], "left_anti").unionByName(_cut(rows.join(F.broadcast(large), ["t", "key"])))
    order = ("t", "key", "p", "q", "node", "n", "group", "side", "distances")
    dealt = whole.select(*order).repartition(*BUCKET).sortWithinPartitions(*BUCKET, "n")

    def kept(rows: pa.Table, bucket: np.ndarray) -> Iterator[pa.RecordBatch]:
        distances = np.frombuffer(b"".join(rows["distances"].to_pylist()), np.uint64).reshape(rows.num_rows, -1)
        wanted = kept_by_pivots(bucket, *(rows[c].to_numpy() for c in ("n", "group", "side")), distances, similarity)
        yield from rows.select(["t", "key", "node", "n", "group"]).filter(pa.array(wanted)).to_batches()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= HELD_ROWS:  # all buckets but the last are whole
                rows = pa.Table.from_batches(held)
                bucket = _numbered(rows)
                whole = int(np.searchsorted(bucket, bucket[-1]))
                held = rows.slice(whole).to_batches()
                yield from kept(rows.slice(0, whole), bucket[:whole])
        if held:
            rows = pa.Table.from_batches(held)
            yield from kept(rows, _numbered(rows))

    out = dealt.mapInArrow(meet, "t int, key int, node long, n int, group long")
    return out.distinct() if cut else out


def _numbered(rows: pa.Table) -> np.ndarray:
    """A number for each run of rows of one bucket."""
    new = np.zeros(rows.num_rows, bool)
    for c in BUCKET:
        own = rows[c].to_numpy()
        new[1:] |= own[1:] != own[:-1]
    return np.cumsum(new)


def _links_in_bands(keyed: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, similarity: float, bucket_rows: int, scratch: Scratch) -> DataFrame:
    """Edges among keyed (node, n, t, key, group) that share a key and are of different groups; keyed is a table of scratch."""
    pieces = F.greatest(F.ceil(F.count("*") / bucket_rows), F.ceil(F.sum("n") / BUCKET_SHINGLES)).cast("int")
    buckets = keyed.groupBy("t", "key").agg(F.count("*").alias("rows"), pieces.alias("pieces"), F.min("group").alias("g1"), F.max("group").alias("g2")).where("rows > 1 and g1 <> g2")
    met = scratch.written(keyed.join(buckets.select("t", "key", "pieces"), ["t", "key"]).select("t", "key", "pieces", "node", "group"), "shared_keys")
    scratch.drop(keyed)
    signed = _cut(met.join(nodes.select("node", "n", "sign"), "node")).select(*BUCKET, "node", "group", "side", "n", "sign")
    signed = signed.repartition(*BUCKET).sortWithinPartitions(*BUCKET, "node")
    schema = "t int, key int, p int, q int, node long, group long, side int, sign binary"

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of nodes with a plausible partner."""
        types = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        out = []
        for at, rows in _buckets(batches):
            node, group, side, n, sign = zip(*rows, strict=True)
            group, side, n = np.unique(group, return_inverse=True)[1], np.array(side), np.array(n)
            signs, wanted = np.frombuffer(b"".join(sign), np.uint8).reshape(len(rows), -1), np.zeros(len(rows), bool)
            for i in range(len(rows) - 1):
                ok = (group[i + 1 :] != group[i]) & ((side[i + 1 :] == 2) | (side[i + 1 :] != side[i])) & (np.minimum(n[i + 1 :], n[i]) >= similarity * np.maximum(n[i + 1 :], n[i]) - 1e-9)
                others = plausible(i, i + 1 + np.flatnonzero(ok), signs, n, at[0], similarity)
                if len(others):
                    wanted[i] = wanted[others] = True
            out += [(*at, node[i], rows[i][1], rows[i][2], sign[i]) for i in np.flatnonzero(wanted).tolist()]
            if len(out) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), types, strict=True)], names)
                out = []
        columns = zip(*out, strict=True) if out else [()] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], names)

    names = [x.split()[0] for x in schema.split(", ")]
    marked = scratch.written(signed.mapInArrow(mark, schema), "met")
    scratch.drop(met)
    # the texts of the nodes that meet others; rows that repeat an id and its words give the same shingles
    wanted = scratch.written(nodes.join(marked.select("node").distinct(), "node", "left_semi").select("doc_id", "node", "digest"), "wanted")
    texts = sifted(docs, wanted, "doc_id", "maybe").where("maybe").drop("maybe").join(wanted, "doc_id")
    sets = scratch.written(_dealt(texts.select("node", "digest", "text"), size).dropDuplicates(["node", "c"]), "shingles")
    rows = marked.join(sets, "node").repartition(*BUCKET).sortWithinPartitions(*BUCKET, "node", "c").select(*BUCKET, "node", "group", "side", "sign", "shingles")

    def linked(at: tuple, held: list[list]) -> Iterator[pa.RecordBatch]:
        signs = np.frombuffer(b"".join(h[3] for h in held), np.uint8).reshape(len(held), -1)
        sets = [np.sort(np.concatenate(h[4]).view(np.uint64)) for h in held]
        n = [len(own) for own in sets]
        pairs = forest_of(sets, np.array([h[2] for h in held]), similarity, np.array([h[1] for h in held]), lambda i, others: plausible(i, others, signs, n, at[0], similarity))
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array([held[i][0] for i, _ in pairs], pa.int64()), pa.array([held[j][0] for _, j in pairs], pa.int64())], ["a", "b"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []  # of the bucket: [node, group, side, sign, [parts of its shingles]]
        for batch in batches:
            *columns, parts = batch.columns
            starts, flat = parts.offsets.to_numpy(), parts.values.to_numpy()
            for i, (t, key, p, q, node, *rest) in enumerate(zip(*(c.to_pylist() for c in columns), strict=True)):
                if (t, key, p, q) != at:
                    if held:
                        yield from linked(at, held)
                    at, held = (t, key, p, q), []
                if not held or held[-1][0] != node:
                    held.append([node, *rest, []])
                held[-1][4].append(flat[starts[i] : starts[i + 1]].copy())
        if held:
            yield from linked(at, held)

    return rows.mapInArrow(find, "a long, b long").distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, similarity: float = SIMILARITY, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, digest, first_id, first_digest, copies) of every different id and text of words with an id: the group's first, and how many rows have both."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("doc_id is not null")
    with Scratch(docs.sparkSession) as scratch:
        found = scratch.written(sketches(own, size), "sketches")
        copies = scratch.written(found.groupBy("doc_id", "digest").agg(F.count("*").alias("copies")), "copies_of_ids")
        nodes = scratch.written(found.groupBy("digest").agg(F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("distances").alias("distances"), F.first("sign").alias("sign"), F.min("doc_id").alias("doc_id")), "nodes")
        scratch.drop(found)
        # an id that is the smallest of several texts names none of them
        twice = scratch.written(nodes.groupBy("doc_id").agg(F.count("*").alias("texts")).where("texts > 1"), "ids_of_several")
        named = scratch.written(nodes.join(twice, "doc_id", "left").withColumn("node", F.when(F.col("texts").isNull(), F.col("doc_id")).otherwise(F.xxhash64("digest"))).drop("texts"), "named_nodes")
        scratch.drop(nodes)
        groups = connected_components(links(named, own, size, similarity, bucket_rows))
        placed = scratch.written(named.select("node", "digest", "doc_id").join(groups, "node", "left").select("digest", "doc_id", F.coalesce("component", "node").alias("component")), "placed")
        firsts = placed.groupBy("component").agg(F.min(F.struct("doc_id", "digest")).alias("first"))
        placed = placed.join(firsts, "component").select("digest", F.col("first.doc_id").alias("first_id"), F.col("first.digest").alias("first_digest"))
        return written(copies.join(placed, "digest").select("doc_id", "digest", "first_id", "first_digest", "copies"), "near_copies")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each group of near copies, that of the smallest id; rows without an id stay, columns stay as they are.

    Of rows that repeat that id and its words one stays. An id's other texts belong to groups of their own. Only rows
    of ids that stand under several rows are looked at again; all others are told by their id alone.
    """
    found = near_copies(docs, id_col, text_col, **options)
    first = (F.col("doc_id") == F.col("first_id")) & (F.col("digest") == F.col("first_digest"))
    found = written(found.select("doc_id", "digest", "copies", first.alias("first")), "copies")
    ids = found.groupBy("doc_id").agg(F.sum("copies").alias("rows"), F.bool_or("first").alias("some"), F.bool_and("first").alias("all"))
    changed = ids.where("not some or not all or rows > 1").select(F.col("doc_id").alias(id_col), (F.col("some") & (F.col("rows") > 1)).alias("several"))
    changed = written(changed, "changed_ids")
    maybe = free_name(docs, "_maybe")
    sorted_out = sifted(docs, changed, id_col, maybe)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    out = sorted_out.where(~F.col(maybe)).select(*columns).unionByName(sorted_out.where(maybe).join(changed.select(id_col), id_col, "left_anti").select(*columns))
    several = changed.where("several").select(id_col)
    if several.isEmpty():
        return out
    name = free_name(docs, "_digest")
    marked = docs.join(several, id_col, "left_semi").withColumn(name, digest_column(F.col(f"`{text_col}`").cast("string")))
    stay = found.where("first").select(F.col("doc_id").alias(id_col), F.col("digest").alias(name))
    one = marked.join(stay, [id_col, name], "left_semi").groupBy(id_col, name).agg(F.min_by(F.struct(*columns), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).alias("row"))
    return out.unionByName(one.select("row.*"))
