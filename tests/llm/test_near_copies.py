"""The pipeline's near copies against brute force over all pairs."""

import random
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from serialspark.llm import near_copies

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        shared = len(sets[a] & sets[b])
        if sets[a] == sets[b] or 5 * shared >= 4 * (len(sets[a]) + len(sets[b]) - shared):
            group[max(root(a), root(b))] = min(root(a), root(b))
    first = {}
    for i, (doc_id, _) in enumerate(rows):
        first[root(i)] = min(first.get(root(i), doc_id), doc_id)
    return sorted(first.values())


def test_stage_keeps_one_of_each_group(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    out = corpus_pipeline.near_dedup(spark, df, SF)
    assert out.columns == df.columns
    kept = sorted(r.doc_id for r in out.select("doc_id").collect())
    assert kept == brute(rows) and not {2, 56} <= set(kept)


@pytest.mark.parametrize("bucket_rows", [2048, 3])
def test_large_groups(spark, bucket_rows):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base[:k], f"x{i}", *base[k + 1 :]])) for i, k in enumerate([0, 59] * 10 + [30] * 5)]
    rows += [(100 + i, "short text") for i in range(3)] + [(200, "Short \n TEXT"), (201, ""), (202, " "), (203, None)]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    assert sorted(r.doc_id for r in near_copies.keep_first(df, bucket_rows=bucket_rows).collect()) == brute(rows)


def test_repeated_and_missing_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(20)) for x in "abc")
    rows = [(1, a), (1, a), (1, a), (2, a), (3, b), (3, c), (3, c), (4, c), (None, a), (None, a)]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    kept = sorted((r.doc_id or 0, r.text) for r in near_copies.keep_first(df).collect())
    assert kept == [(0, a), (0, a), (1, a), (3, b), (3, c)]
    assert near_copies.keep_first(df.limit(0)).count() == 0


def test_repeated_rows_without_a_text(spark):
    df = spark.createDataFrame([(5, None, "x", None, None)] * 3 + [(6, "", "y", None, None)], DOCS).withColumnRenamed("source", "_digest")
    assert [(r.doc_id, r.text, r.lang) for r in near_copies.keep_first(df).collect()] == [(5, None, "x")]


def test_recall_at_the_similarity(spark):
    """Pairs of 200 words of which 4 differ share 176 of 216 shingles; each is a group of its own."""
    rng, rows = random.Random(5), []
    for i in range(500):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        copy = list(words)
        for k in rng.sample(range(1, 38), 4):
            copy[5 * k] = f"x{i}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    kept = {r.doc_id for r in near_copies.keep_first(df).collect()}
    pairs = [i for i in range(500) if 5 * len(shingles(rows[2 * i][1]) & shingles(rows[2 * i + 1][1])) >= 4 * len(shingles(rows[2 * i][1]) | shingles(rows[2 * i + 1][1]))]
    assert len(pairs) > 400 and {2 * i for i in range(500)} <= kept
    assert sum(2 * i + 1 not in kept for i in pairs) >= 0.99 * len(pairs)


def test_plain_pairs_are_told_by_signatures_alone():
    """Signatures of pairs at the similarity pass; of pairs that share a third hardly any does."""
    rng = np.random.default_rng(1)
    for shared, least, most in ((0.8, 0.99, 1.0), (1 / 3, 0.0, 0.01)):
        n = round(2 * 300 * shared / (1 + shared))
        passed = 0
        for _ in range(200):
            a, b, c = (rng.integers(0, 1 << 63, k, np.uint64) for k in (n, 300 - n, 300 - n))
            signs = [near_copies.minima_of(np.r_[a, x]).astype(np.uint8) for x in (b, c)]
            passed += (signs[0] == signs[1]).sum() >= near_copies.least_agreeing(0.8)
        assert least <= passed / 200 <= most
