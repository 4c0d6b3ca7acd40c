"""The pipeline's near copies: SimHash brings together, the table of pivot distances discards and loses nothing that is near."""

import math

import numpy as np
import pytest

from serialspark.llm import near_copies
from test_near_copies import DOCS, brute

RNG = np.random.default_rng(3)


def pair(n, shared):
    """The bits of two sets of n hashes that share so many."""
    a, b, c = (RNG.integers(0, 1 << 63, k, np.uint64) for k in (shared, n - shared, n - shared))
    return near_copies.bits_of(np.r_[a, b]), near_copies.bits_of(np.r_[a, c])


def far(a, b):
    """The sum of the coordinates' differences, counted plainly from the fingerprints and the pivots."""
    of = [(x[: near_copies.TABLE_BITS] != near_copies._PIVOTS).reshape(-1, 2).sum(axis=1) for x in (a, b)]
    return int(np.abs(of[0] - of[1]).sum())


def words(*rows):
    return np.frombuffer(b"".join(map(near_copies.pivot_distances, rows)), np.uint64).reshape(len(rows), -1)


@pytest.mark.parametrize("n, shared, least, most", [(90, 80, 0.995, 1), (300, 267, 0.995, 1), (300, 0, 0, 0.01)])
def test_pivots_discard_plain_pairs_and_no_near_ones(n, shared, least, most):
    stay = 0
    for _ in range(300):
        a, b = pair(n, shared)
        table = words(a, b)
        differ = np.bitwise_count(table[0] ^ table[1]).sum()
        assert differ == far(a, b) <= (a != b)[: near_copies.TABLE_BITS].sum()
        sides = np.full(2, 2)
        kept = near_copies.kept_by_pivots(np.zeros(2, int), np.full(2, n), np.arange(2), sides, table, 0.8)
        assert kept[0] == kept[1]
        stay += kept[0]
    assert least <= stay / 300 <= most


def test_bits_differ_as_the_angle_says():
    share = np.mean([np.mean(np.not_equal(*pair(450, 400))) for _ in range(100)])
    assert abs(share - math.acos(400 / 450) / math.pi) < 0.01
    assert near_copies.bits_of(np.zeros(0, np.uint64)).sum() == 0


def test_kept_by_pivots_as_plain_loops_do():
    rows = [x for _ in range(30) for x in pair(100, 89)] + [pair(100, 0)[0] for _ in range(40)]
    n, group, side, bucket = RNG.integers(90, 140, 100), RNG.integers(0, 60, 100), RNG.integers(0, 3, 100), RNG.integers(0, 4, 100)
    order = np.lexsort((n, bucket))
    table = words(*[rows[i] for i in order])
    n, group, side, bucket = (x[order] for x in (n, group, side, bucket))
    most = near_copies.most_apart(near_copies.TABLE_BITS, 0.8)

    def met(i, j):
        sizes = min(n[i], n[j]) >= 0.8 * max(n[i], n[j])
        return i != j and bucket[i] == bucket[j] and group[i] != group[j] and (2 in (side[i], side[j]) or side[i] != side[j]) and sizes and far(rows[order[i]], rows[order[j]]) <= most

    side[:] = np.where(bucket % 2, 2, side % 2)  # a bucket is of one piece or of two
    assert near_copies.kept_by_pivots(bucket, n, group, side, table, 0.8).tolist() == [any(met(i, j) for j in range(100)) for i in range(100)]


@pytest.mark.parametrize("meet_rows", [1000, 3])
def test_the_stored_table_decides_who_meets(spark, meet_rows):
    """Rows of the same keys stay only where their pivot distances are near, in whole buckets and in cut ones."""
    a, b = pair(300, 280)
    c = 1 - a
    rows = [(i, 300, bytearray(near_copies.pivot_distances(x)), [5, 6], g) for i, (x, g) in enumerate([(a, 0), (b, 1), (c, 2), (a, 0)])]
    rows += [(9, 300, bytearray(near_copies.pivot_distances(a)), [7, 8], 9), (10, 200, bytearray(near_copies.pivot_distances(a)), [5, 6], 10)]
    table = spark.createDataFrame(rows, "node long, n int, distances binary, keys array<smallint>, group long")
    out = sorted((r.t, r.key, r.node) for r in near_copies._met_by_pivots(table, 4, 0.8, meet_rows).collect())
    assert out == [(t, k, i) for t, k in ((4, 5), (5, 6)) for i in (0, 1, 3)]


def test_tiny_texts(spark):
    """Nine words that begin with another text's eight: four of five shingles are shared."""
    rows = []
    for i in range(400):
        text = [f"w{i}x{k}" for k in range(9)]
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(text[:8]))]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    kept = {r.doc_id for r in near_copies.keep_first(df).collect()}
    assert brute(rows) == list(range(0, 800, 2)) and set(range(0, 800, 2)) <= kept
    assert len(kept) <= 404


def test_cut_buckets_of_near_copies(spark):
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*base[:k], f"x{i}", *base[k + 1 :]])) for i, k in enumerate(list(range(0, 120, 3)) * 2)]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    assert sorted(r.doc_id for r in near_copies.keep_first(df, bucket_rows=1).collect()) == brute(rows) == [0]
