"""Rules that beat chance: found where the tokens tell, none where labels fall at random."""

import random

import pytest

from serialspark.llm import queries, url_filter

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("seed", [1, 2])
def test_no_rule_under_shuffled_labels(spark, seed):
    pages, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("pages", "labels"))
    rows = [(r.url, r.bad) for r in url_filter.labelled_urls(pages, labels).collect()] * 5
    bad = [b for _, b in rows]
    random.Random(seed).shuffle(bad)
    shuffled = spark.createDataFrame([(u, b) for (u, _), b in zip(rows, bad, strict=True)], "url string, bad boolean")
    assert url_filter.mine(shuffled).count() == 0


def test_a_rule_needs_enough_rows(spark):
    rng = random.Random(3)
    rows = [(f"http://h{rng.randrange(5)}.org/{rng.choice('abcd')}{rng.randrange(9)}/casino/{i}", rng.random() < 0.9) for i in range(60)]
    rows += [(f"http://h{rng.randrange(5)}.org/{rng.choice('abcd')}{rng.randrange(9)}/news/{i}", rng.random() < 0.1) for i in range(300)]
    rows += [(f"http://rare.org/one/{i}", True) for i in range(5)]
    rules = url_filter.mine(spark.createDataFrame(rows, "url string, bad boolean")).collect()
    tokens = [set(r.tokens) for r in rules]
    assert {"p:casino"} in tokens and not any("p:news" in t and "p:casino" not in t for t in tokens)
    assert all(r.confidence > 0.5 and r.anchor in r.tokens for r in rules)


def test_hot_urls_and_other_columns(spark):
    labelled = spark.createDataFrame([(f"http://x.org/casino/{i}", True) for i in range(50)] + [(f"http://x.org/home/{i}", False) for i in range(100)], "url string, bad boolean")
    pages = spark.createDataFrame([(i, "http://y.com/casino/1" if i % 3 else None, "n", "h") for i in range(30_000)], "page_id long, url string, n_rules string, host string")
    out = url_filter.judge(pages, labelled)
    assert out.count() == 30_000 and out.where("verdict = 'block'").count() == 20_000 and out.where("host = '' and verdict = 'allow'").count() == 10_000
    assert url_filter.judge(pages.limit(0), labelled).count() == 0 and queries.op4_url_filter(spark, SF).count() > 0
