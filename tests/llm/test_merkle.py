"""Merkle manifests and proofs against trees built level by level in plain Python."""

import hashlib
import zlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from serialspark.llm import merkle, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string"
H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()


def leaf(*values):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """(root, the siblings of each leaf as (before, after) by level)"""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            lo = a - a % 16
            ways[i].append((nodes[lo:a], nodes[a + 1 : lo + 16]))
        nodes, at = [H(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)], [a // 16 for a in at]
    return nodes[0], ways


def brute(rows):
    """rows: (doc_id, text, lang, source, n_chars)"""
    made = [(r[3], r[0], leaf(r[0], r[3], r[2], r[4], r[1]), leaf(r[0], r[3], r[2], r[4], r[1] and r[1].encode().lower().decode()) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else None) for r in rows]
    made.sort(key=lambda x: (x[0] is not None, (x[0] or "").encode(), x[1] is not None, x[1] or 0, x[2]))
    groups = [(s, list(g)) for s, g in groupby(made, lambda x: x[0])]
    trees = [tree([x[2] for x in g]) for _, g in groups]
    root, tops = tree([t[0] for t in trees])
    out = []
    for (_, g), (subroot, ways), top in zip(groups, trees, tops, strict=True):
        for (_, i, own, changed), way in zip(g, ways, strict=True):
            x = changed or own
            for before, after in way + top:
                x = H(*before, x, *after)
            out.append((i, own, subroot, root, H(*(d for b, a in way + top for d in b + a)), x, x == root))
    return out


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    found = [tuple(r) for r in queries.op12_merkle(spark, SF).collect()]
    assert sorted(found) == sorted(brute(rows))
    assert 0 < sum(not r[-1] for r in found) < len(found) / 3


@pytest.fixture
def odd_rows():
    """Trees of 1, 2, 16, 17, 256, 257 and 4,500 leaves, nulls, repeated rows and ids, a long text."""
    sizes = {None: 17, "": 1, "a": 2, "é": 16, "b": 256, "z": 257, "hot": 4500}
    rows = [(i * 7 + k, f"Text {i} \n é", "de", s, i) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    rows += [(None, None, None, "a", None), (None, "", "x", "a", 0), (3, "A" * 1_000_000, None, "a", 1), (3, "B", None, "a", 1), (3, "B", None, "a", 1), (2**62 + 1, "C", None, "a", 1), (2**62, "D", None, "a", 1)]
    return rows


def test_odd_rows(spark, odd_rows):
    df = spark.createDataFrame([(*r, "x") for r in odd_rows], DOCS).repartition(5)
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    found = merkle.manifest(df, columns, F.col("source"), F.col("doc_id"))
    proof = merkle.siblings_digest(F.col("before"), F.col("after"))
    root = merkle.folded(F.col("leaf"), F.col("before"), F.col("after"))
    found = [(r.tree, *r[1:6]) for r in found.select("tree", "id", "leaf", "subroot", "root", proof.alias("p"), root.alias("f")).collect() if r.f == r.root]
    # without tampering all rows fold to the root
    assert len(found) == len(odd_rows)
    assert sorted(map(str, (r[1:] for r in found))) == sorted(map(str, (r[:5] for r in brute(odd_rows))))
    assert {r[0] for r in found} == {None, "", "a", "é", "b", "z", "hot"}


def test_empty_table(spark):
    df = spark.createDataFrame([], DOCS)
    assert merkle.manifest(df, [F.col("text")], F.col("source"), F.col("doc_id")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 16, 17, 255, 256, 300, 5000])
def test_positions_are_those_of_completion(n):
    height = merkle.height_of(n)
    log = merkle.log_of([f"{i:064x}" for i in range(n)], height)
    names, nodes, level = {}, [f"{i:064x}" for i in range(n)], 0
    while True:
        names |= {(level, i): x for i, x in enumerate(nodes)}
        if len(nodes) == 1:
            break
        nodes, level = [H(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)], level + 1
    assert len(log) == 32 * len(names) and level == height
    for (level, i), x in names.items():
        at = 32 * merkle.position(i, level, n)
        assert log[at : at + 32].hex() == x
