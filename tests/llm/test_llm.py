"""The training-data operators against brute force, exact round trips and held-out accuracy, and odd inputs."""

import base64
import hashlib
import math
import random
import struct
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from test_near_copies import brute as near_groups

from serialspark.llm import bpe, components, decontam, langid, media, pii, queries, simhash, token_counts, toxicity, url_filter, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(None, None), (1, None), (2, ""), (3, " \n "), (4, "a"), (4, "a"), (5, "word " * 30000), (6, "日本語 ñ é 🙂 \x1c x")]


def docs(spark, rows=None):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in (ODD if rows is None else rows)], DOCS)


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas()


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a long, b long")
    found = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert found == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100}


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("bucket_rows", [4096, 3])
def test_simhash(spark, given, bucket_rows):
    rows = [*ODD, *given[["doc_id", "text"]].assign(doc_id=given.doc_id + 1000).itertuples(index=False, name=None)]
    # near copies of one text, so that buckets are cut into pieces
    rows += [(5000 + i, " ".join(["common"] * 400 + [f"x{i}"])) for i in range(12)]
    out = simhash.near_duplicates(docs(spark, rows), bucket_rows=bucket_rows).collect()
    assert len(out) == len(rows)
    fps = {i: brute_fingerprint(t) for i, t in rows if i is not None}
    group = {i: i for i in fps}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in combinations(sorted(fps), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 3 and root(a) != root(b):
            group[max(root(a), root(b))] = min(root(a), root(b))
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (int(r.fingerprint, 16), r.component_id) == (fps[r.doc_id], root(r.doc_id))


def test_keep_first(spark):
    text = "one two three four five six"
    kept = simhash.keep_first(docs(spark, [(1, text), (2, text), (None, text), (3, "quite another text than the first of them")])).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 1, 3]
    assert simhash.keep_first(docs(spark, [])).count() == 0


def test_bpe(spark, given):
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    theirs = Tokenizer.from_file(path)
    theirs.no_truncation(), theirs.no_padding()
    rnd = random.Random(3)
    noise = ["".join(chr(rnd.choice([rnd.randint(32, 126), rnd.randint(0xA0, 0x52F), 0x300 + rnd.randint(0, 40), 32])) for _ in range(40)) for _ in range(60)]
    rows = list(enumerate([*[t for _, t in ODD], *noise, "<|endoftext|>a<|startoftext|> B", "aaaaaaaaaaaa aaa", "It's I'LL ΑΣ İ", *given.text[:60]]))
    df = docs(spark, rows)
    got = {r.doc_id: r for r in bpe.digests(df, path).collect()}
    full = {r.doc_id: r for r in bpe.encode_decode(df, path, "ids", "decoded").collect()}
    for i, t in rows:
        ids = theirs.encode(t or "", add_special_tokens=False).ids
        decoded = theirs.decode(ids, skip_special_tokens=False)
        assert full[i].ids == ids and full[i].decoded == decoded
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_media(spark):
    rows = docs(spark)
    got = media.tiles(media.store(rows)).collect()
    stored = {(r.doc_id, r.payload_sha256) for r in got}
    for i, t in ODD:
        data = (t or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
        assert (i, hashlib.sha256(payload).hexdigest()) in stored
    assert all(r.payload_bytes % 576 == 0 and r.payload_bytes > 0 and len(r.feature) == 16 for r in got)
    image = np.random.default_rng(1).integers(0, 256, (48, 24, 3)).astype(np.uint8)
    for kind in media.KINDS:
        assert media.decode(media.encode(image.tobytes(), kind)).tobytes() == image.tobytes()
    assert (media.resize(image, 6, 8) == np.floor(image.mean(axis=2).reshape(8, 6, 6, 4).mean(axis=(1, 3)) + 0.5)).all()
    tile = np.load(__import__("io").BytesIO(bytes(got[0].tile)))
    assert media.difference_hash(tile) == got[0].feature
    with pytest.raises(ValueError):
        media.decode(b"P7 1 1")


@pytest.mark.parametrize("block", [7, 1 << 19])
def test_token_counts(spark, given, block):
    import tiktoken

    ranks = token_counts.read_ranks(queries.vocabulary("byte_bpe_50k.tiktoken"))
    codec = tiktoken.Encoding("t", pat_str=queries.BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [r for r in ODD if len(r[1] or "") < 1000] + list(given[["doc_id", "text"]].head(12).assign(doc_id=range(50, 62)).itertuples(index=False, name=None))
    out = token_counts.counts(docs(spark, rows).repartition(2), ranks, queries.BYTE_PATTERN, block_tokens=block).collect()
    want = sorted((str(i), len(codec.encode_ordinary(t or ""))) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens) for r in out) == want


def test_scan_of_a_file_without_a_last_separator(spark):
    tokens = np.array([5, 9, 9, 5, 5, 9, 5, 5], "<u2")  # 9 separates
    blocks = [(1, i, tokens[2 * i : 2 * i + 2].tobytes()) for i in range(4)]
    out = token_counts.scan(spark.createDataFrame(blocks, "file_id long, block_no long, data binary"), 9, stretch=2).sort("doc_no").collect()
    assert [(r.start_token, r.n_tokens) for r in out] == [(0, 1), (2, 0), (3, 2), (6, 2)]


def test_decontamination(spark):
    items = [(i, t) for i, t in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()] + [(900, ""), (901, None), (902, "two words")]
    index = decontam.Index([x for x in items if x[1]])
    rnd, rows, truth = random.Random(4), [], {}
    foreign = lambda n: [f"zq{rnd.randrange(10**6)}" for _ in range(n)]
    for i in range(60):
        item_id, text = items[rnd.randrange(len(items) - 3)]
        words = decontam.words_of(text)
        edits = rnd.randint(0, index.edits(len(words)) + 3)
        for _ in range(edits):
            at = rnd.randrange(len(words))
            kind = rnd.randrange(3)
            words[at : at + (kind != 1)] = [] if kind == 2 else foreign(1)
        rows.append((i, " ".join(foreign(rnd.randrange(30)) + words + foreign(rnd.randrange(30)))))
    rows += [(100, None), (101, ""), (102, "Two, WORDS!"), (103, " ".join(foreign(50)))]
    for i, t in rows:
        ids = np.array([index.vocabulary.get(w, 0) for w in decontam.words_of(t)])
        for item, words in zip(index.ids, index.words, strict=True):
            d = decontam.best_match(words, ids)[0]
            if d <= index.edits(len(words)):
                truth[i, item] = d
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.distance for r in decontam.find_leaks(docs(spark, rows), bench).collect()}
    assert set(found) <= set(truth) and all(found[k] == truth[k] for k in found)
    assert len(found) >= 0.97 * len(truth)
    kept = {r.doc_id for r in decontam.drop_leaking(docs(spark, rows), bench).collect()}
    assert kept == {i for i, _ in rows} - {i for i, _ in found}
    assert decontam.drop_leaking(docs(spark, rows), bench.limit(0)).count() == len(rows)


def test_best_match_is_levenshtein():
    rnd = np.random.default_rng(2)
    for _ in range(50):
        a, b = rnd.integers(1, 5, rnd.integers(1, 9)), rnd.integers(1, 5, rnd.integers(0, 14))
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        assert decontam.best_match(a, b)[0] == min(row)


def test_language(spark, given):
    train = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(train, train).toPandas().merge(given, on="doc_id")
    held = got[got.held_out]
    assert len(held) and (held.lang_pred == held.lang).mean() > 0.95
    odd = langid.identify(docs(spark), train).collect()
    assert [(r.lang_pred, r.score) for r in odd if r.doc_id in (None, 1, 2, 3)] == [("und", 0.0)] * 4
    assert {r.lang_pred for r in langid.identify(docs(spark), docs(spark)).collect()} == {"und"}
    kept = {r.doc_id for r in langid.keep_known(train, train).select("doc_id").collect()}
    assert len(kept) >= 0.99 * len(given)


def test_forward_backward():
    rng = np.random.default_rng(1)
    e, t = rng.random((5, 3)) + 0.1, rng.random((3, 3)) + 0.1
    p = langid.forward_backward(e.copy(), t, np.array([0, 3]), np.array([3, 2]))
    for lo, n in ((0, 3), (3, 2)):
        want = np.zeros((n, 3))
        for path in np.ndindex(*[3] * n):
            w = math.prod(e[lo + i, k] for i, k in enumerate(path)) * math.prod(t[a, b] for a, b in zip(path, path[1:], strict=False))
            for i, k in enumerate(path):
                want[i, k] += w
        assert np.allclose(p[lo : lo + n], want / want.sum(axis=1, keepdims=True))


def test_toxicity(spark, given):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score_documents(d, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    clean, toxic = got[got.toxic == 0], got[got.toxic == 1]
    assert clean.predicted.mean() < 0.03 and toxic.predicted.mean() > 0.75
    assert got.score.between(0, 1).all()
    index = toxicity.fit(d, labels)
    dense = np.zeros((len(index.toxic), len(index.terms)))
    for t in range(len(index.terms)):
        at = slice(index.start[t * index.blocks], index.start[(t + 1) * index.blocks])
        dense[index.example[at], t] = index.weight[at]
    for text in given.text[:100]:
        terms, weight = index.vector(toxicity.term_counts(text))
        if len(terms):
            s = dense[:, terms] @ weight
            assert np.allclose(np.sort(s[s > 1e-12])[::-1][: index.k], [c for c, _ in index.nearest((terms, weight))])
    assert {r.score for r in toxicity.score_documents(docs(spark), labels.limit(0)).collect()} == {0.0}


def luhn(s):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(s))) % 10 == 0


def test_pii(spark):
    rows = [(1, "card 4539578763621486 and 4539-5787-6362-1486, not 4539578763621487."), (2, "call +1 (017) 555-7713 or 017-555-7713"), (3, "und.34@mail7.example.com at 97.51.17.173, not 999.1.1.1"), (4, "DE89 3704 0044 0532 0130 00"), (5, "2024-02-29 29/02/2024 2023-02-29"), (6, "123-45-6789 666-12-1234")]
    df = docs(spark, [*rows, *[(i + 20 if i else i, t) for i, t in ODD]]).withColumn("_found", F.lit("kept"))
    out = pii.pseudonymize(df, "secret", count_as="n", kinds_as="kinds").collect()
    assert len(out) == len(rows) + len(ODD) and {r._found for r in out} == {"kept"}
    by = {r.doc_id: r for r in out}
    one = by[1].text.split()
    assert one[1] != "4539578763621486" and luhn(one[1]) and one[3].strip(",").replace("-", "") == one[1] and one[5] == "4539578763621487."
    first, second = by[2].text[5:].split(" or ")
    assert first.startswith("+1 (") and first[4:7] + first[9:] == second.replace("-", "", 1) != "017555-7713"
    assert "und.34@" not in by[3].text and "97.51.17.173" not in by[3].text and "999.1.1.1" in by[3].text
    iban = by[4].text.replace(" ", "")
    assert iban[:2] == "DE" and iban != "DE89370400440532013000" and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    a, b, c = by[5].text.split()
    assert "-".join(reversed(b.split("/"))) == a != "2024-02-29" and c == "2023-02-29"
    assert by[6].text.split()[0] != "123-45-6789" and by[6].text.split()[1] == "666-12-1234"
    assert [by[i].kinds for i in range(1, 7)] == [["card"], ["phone"], ["email", "ip"], ["iban"], ["date"], ["ssn"]]
    assert by[21].text is None and by[22].text == ""


def test_pii_permutes(spark):
    n = spark.range(10000).select(pii.permuted(F.lpad(F.col("id").cast("string"), 4, "0"), 10, "k", "t").alias("p"))
    assert n.distinct().count() == 10000 and n.where(F.length("p") == 4).count() == 10000


def test_warc(spark):
    rows = [(1, "http://a/", "same"), (2, "http://b/\r\nx", "same"), (3, None, "WARC/1.1\r\n\r\nx\r\n\r\n"), (4, "u", None), (5, "u", ""), (None, "u", "same"), (6, "u", "é" * 50000)]
    out = {r.page_id: r for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(out) == len(rows)
    for i, _, html in rows:
        data = (html or "").encode()
        assert (out[i].payload_bytes, out[i].payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
    assert [(out[i].record_type, out[i].refers_to) for i in (1, 2, 4, 5)] == [("revisit", 2), ("response", None), ("revisit", 5), ("response", None)]
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_url_filter(spark):
    bad = [(f"http://spam{i % 2}.example.org/casino/{i}", True) for i in range(40)]
    good = [(f"http://news.example.org/home/{i}", False) for i in range(60)]
    labelled = spark.createDataFrame([*bad, *good], "url string, bad boolean")
    urls = ["http://x.org/casino/9", "http://EXAMPLE.net/en/1?q", "http://a.example.net/x", "http://b.example.com/de/", "http://b.org/fr/casino/", None, "nothing", "http://x.org/home/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, labelled).collect()}
    assert got[0] == ("x.org", "/casino/9", None, "block") and got[1] == ("example.net", "/en/1", "example.net/en/", "allow")
    assert got[2][2:] == ("net/", "block") and got[3][2:] == ("example.com/de/", "block") and got[4][2:] == ("org/fr/", "allow")
    assert got[5] == got[6] == ("", "", None, "allow") and got[7][3] == "allow"
    assert url_filter.judge(pages, labelled.limit(0)).where("rule is null and verdict = 'block'").count() == 0


def test_pipeline(spark, given):
    import corpus_pipeline

    df = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns, name
    kept = [r.doc_id for r in corpus_pipeline.near_dedup(spark, df, SF).select("doc_id").collect()]
    assert sorted(kept) == near_groups([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    final = corpus_pipeline.run(spark, SF)
    assert 0 < final.count() <= len(given) and set(final.columns) >= {"doc_id", "n_tokens", "ids"}
