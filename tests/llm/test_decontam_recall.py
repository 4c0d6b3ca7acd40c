"""Short items, starts counted from each document, classes that miss their recall, and items without an id."""

import random

import pytest
from pyspark.sql import functions as F

from serialspark.llm import decontam


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_short_items_are_found_everywhere(n):
    item = [f"item{i}" for i in range(n)]
    index = decontam.Index([(7, " ".join(item))])
    texts = [" ".join([f"x{i}" for i in range(k)] + item + ["y"] * 9) for k in range(30)]
    assert all([m[:2] for m in found] == [(7, 0)] for found in index.search(texts))
    assert [index.search([t])[0] for t in texts] == index.search(texts)


def test_a_class_that_misses_its_recall_is_aligned_exactly(monkeypatch):
    monkeypatch.setattr(decontam, "MOST_REPETITIONS", 1)
    words = [f"w{i}" for i in range(30)]
    index = decontam.Index([(1, " ".join(words))])
    assert [c.exact for c in index.classes] == [True]
    rnd, texts = random.Random(1), []
    for k in range(60):
        edited = list(words)
        for at in rnd.sample(range(1, 29), 6):
            edited[at] = "zz"
        texts.append(" ".join(["x"] * k + edited + ["y"] * 9))
    assert all([m[:2] for m in found] == [(1, 6)] for found in index.search(texts))


def test_items_without_an_id(spark):
    bench = spark.createDataFrame([(None, "secret words of a test"), (None, "quite other words here"), (3, "one more item there")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a secret words of a test b quite other words here one more item there"), (2, "clean")], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id or 0) for r in decontam.find_leaks(docs, bench).collect()) == [(1, 0), (1, 0), (1, 3)]
    assert [r.doc_id for r in decontam.drop_leaking(docs, bench).collect()] == [2]


@pytest.mark.parametrize("n", [20, 200, 2000, 8000])
def test_recall_at_every_length(n):
    rnd = random.Random(n)
    items = [(i, " ".join(f"w{rnd.randrange(30000)}" for _ in range(n))) for i in range(8 if n < 2000 else 2)]
    index, texts, want = decontam.Index(items), [], []
    for _ in range(100 if n <= 200 else 12):
        i = rnd.randrange(len(items))
        words = items[i][1].split()
        for _ in range(index.edits(n)):
            at = rnd.randrange(len(words))
            words[at : at + 1] = ([], ["zz"], ["zz", words[at]])[rnd.randrange(3)]
        texts.append(" ".join([f"f{k}" for k in range(rnd.randrange(40))] + words + ["q"] * 7))
        want.append(i)
    assert sum(i in [m[0] for m in found] for i, found in zip(want, index.search(texts), strict=True)) >= 0.98 * len(texts)
    assert sum(a.nbytes for c in index.classes for a in (*c.keys, *c.owners, *c.salts)) < 5_000_000


def test_blocks_find_the_same(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("_leaks", F.lit(1))
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    rows = lambda **options: sorted(map(tuple, decontam.find_leaks(df, bench, **options).collect()))
    assert rows() == rows(block_chars=5000) != []
    kept = decontam.drop_leaking(df, bench, block_chars=5000)
    assert kept.columns == df.columns and kept.count() == df.count() - len({r[0] for r in rows()})
    assert decontam.find_leaks(df.limit(0), bench).count() == decontam.find_leaks(df, bench.limit(0)).count() == 0
