"""Log-likelihoods of documents by a gated recurrent language model, beside those of smoothed counts.

Tokens are words (runs outside ASCII white space, A-Z lower-cased) and one end for each text. Training documents give
each token's count c, the sum N and the number V of different tokens. The base is log10((c + 0.5) / (N + 0.5 (V + 1))).

The network reads ids: the ``HEADS`` most frequent tokens (the end among them) have their own, all other tokens that of
one of ``TAILS`` classes, which a hash of their last two bytes chooses. Its output is factored into classes: within a class of
heads a second softmax chooses the word, within a class of others the smoothed counts of that class do. So every
token has a probability, and those of all tokens known and one unknown of each class add up to 1. It begins with the shares
that the counts give. A hash deals the training documents to ``SHARES`` shares; in ``ROUNDS`` rounds, each over one
share, every task learns from its partition's whole texts (in stretches of 1,024 tokens) by truncated backpropagation, starting from the same parameters,
and the results' mean, weighted by tokens, starts the next round. The rounds are as many as the shares, so the
network learns from all training documents, as the counts do. Scoring carries the state through the whole text.

Tokens are told apart by 64-bit hashes, so two may be taken for one: with 10 million different tokens one chance in 370,000.
What tasks receive is bounded: at most ``FREQUENT`` tokens' counts and the parameters. All other tokens of a document meet their
counts in a join, in which no token is hot, since the frequent ones are not part of it. Sums of floats depend on how documents are
batched in the last digits (relative 1e-6); learning amplifies that, to less than 1e-4 of most scores and some percent of a few.

Null texts count as empty, which is one end. A row without an id is a training document. Rows that repeat an id are
documents of their own. Without training documents each token's base is 0. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_bucket, written
from .flat import Words, hashes_of, texts_of, words_of
from .gru import LANES, WINDOW, Network, Shape, initial

HEADS, WIDTH, TAILS, HIDDEN, SHARES, ROUNDS, FREQUENT, SLICES = 1024, 32, 64, 24, 8, 8, 1 << 18, 16
BATCH_TOKENS = 3_000_000
SHAPE = Shape(HEADS, WIDTH, HEADS // WIDTH + TAILS, HIDDEN)
END = 0  # the end's hash
_IS_WORD = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])


def tail_of(words: Words) -> np.ndarray:
    """The class of each word among others, from its last two bytes."""
    last = words.data[words.end - 1].astype(np.int64)
    before = words.data[np.maximum(words.end - 2, words.start)].astype(np.int64)
    return ((before * 256 + last) * 2654435761 >> 10) % TAILS


def token_counts(texts: DataFrame) -> DataFrame:
    """(token, tail, n) of all tokens of texts (text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = 0
        for batch in batches:
            rows += batch.num_rows
            for _, _, data, offsets in texts_of(batch.column(0)):
                words = words_of(data, offsets, _IS_WORD)
                token, first, n = np.unique(hashes_of(words), return_index=True, return_counts=True)
                yield _batch(token=token, tail=tail_of(words)[first], n=n)
        if rows:
            yield _batch(token=np.array([END]), tail=np.array([-1]), n=np.array([rows]))

    return texts.mapInArrow(count, "token long, tail long, n long").groupBy("token", "tail").agg(F.sum("n").alias("n"))


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], list(columns))


class Counts:
    """What tasks need to know of the corpus: the frequent tokens' counts, sorted by hash, the heads' ids and the classes' sums."""

    def __init__(self, counts: DataFrame):
        level = F.floor(F.log2("n") * 16)
        levels = counts.groupBy(level.alias("level")).agg(F.count("*").alias("tokens"), F.sum("n").alias("n")).toPandas().sort_values("level", ascending=False)
        self.total, self.types = int(levels["n"].sum()), int(levels["tokens"].sum())
        few = levels["level"][levels["tokens"].cumsum() <= FREQUENT]
        found = counts.where((level >= int(few.min())) | (F.col("token") == END)).toPandas() if len(few) else pd.DataFrame({"token": [], "tail": [], "n": []}, dtype=np.int64)
        tails = counts.where("tail >= 0").groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("tokens")).toPandas().astype(np.int64)
        found = found.astype(np.int64).sort_values(["n", "token"], ascending=[False, True])
        found = pd.concat([found[found["token"] == END], found[found["token"] != END]])
        head = found[:HEADS]
        self.head_n = np.zeros(HEADS, np.int64)
        self.head_n[: len(head)] = head["n"]
        n, types = np.zeros(TAILS, np.int64), np.zeros(TAILS, np.int64)
        n[tails["tail"]], types[tails["tail"]] = tails["n"], tails["tokens"]
        own = head[head["tail"] >= 0]
        np.subtract.at(n, own["tail"].to_numpy(), own["n"].to_numpy())
        np.subtract.at(types, own["tail"].to_numpy(), 1)
        self.tail_n, self.tail_types = n, types
        order = np.argsort(found["token"].to_numpy(), kind="stable")
        self.token, self.n = found["token"].to_numpy()[order], found["n"].to_numpy()[order]
        self.head_id = np.where(order < HEADS, order, -1).astype(np.int32)

    @property
    def divisor(self) -> float:
        return self.total + 0.5 * (self.types + 1)

    def base(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + 0.5) / self.divisor)

    def within_tail(self) -> np.ndarray:
        """What is added to the base of a token of a tail's class to have its probability within the class."""
        return np.log10(self.divisor / (self.tail_n + 0.5 * (self.tail_types + 1)))

    def network(self) -> Network:
        """The network that begins with the counts' shares."""
        heads = (self.head_n + 0.5).reshape(-1, WIDTH)
        classes = np.concatenate([heads.sum(axis=1), self.tail_n + 0.5])
        return Network(SHAPE, initial(SHAPE, classes / classes.sum(), (heads / heads.sum(axis=1, keepdims=True)).ravel()))


ENCODED = "key long, doc_id long, held_out boolean, n_tokens long, known long, base double, rest double, ids binary, rare array<long>, times array<int>"


def encoded(docs: DataFrame, counts: Counts) -> DataFrame:
    """docs (doc_id, held_out, text) with ids for the network and what is known without a join.

    known, base: over frequent tokens; rest: what their part in classes of others, and all tokens' classes, add to a score.
    rare, times: the other tokens and how often each stands in the text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, row = shared.value, TaskContext.get().partitionId() << 36
        base, within = counts.base(counts.n), counts.within_tail()
        end = np.flatnonzero(counts.token == END)
        end_base, end_known = (base[end[0]], 1) if len(end) else (float(counts.base(np.zeros(1))[0]), 0)
        for batch in batches:
            for lo, hi, data, offsets in texts_of(batch.column(2)):
                words = words_of(data, offsets, _IS_WORD)
                token, tail, size = hashes_of(words), tail_of(words), np.diff(words.first)
                of = np.repeat(np.arange(hi - lo), size)
                at = np.minimum(np.searchsorted(counts.token, token), max(0, len(counts.token) - 1))
                hit = counts.token[at] == token if len(counts.token) else np.zeros(len(token), bool)
                head = np.where(hit, counts.head_id[at], -1) if len(counts.token) else np.full(len(token), -1)
                add = lambda x, where: np.bincount(of[where], x[where], minlength=hi - lo).astype(np.float64)
                own = base[at] if len(base) else np.zeros(len(token))
                tails = head < 0
                ids = np.zeros(len(token) + hi - lo, "<u2")  # the end is the first head
                ids[np.arange(len(token)) + of] = np.where(tails, HEADS + tail, head)
                rare = np.flatnonzero(~hit)
                pairs = np.lexsort((token[rare], of[rare]))
                r_of, r_token = of[rare][pairs], token[rare][pairs]
                first = np.flatnonzero(np.r_[True, (r_of[1:] != r_of[:-1]) | (r_token[1:] != r_token[:-1])]) if len(rare) else np.zeros(0, np.int64)
                times = np.diff(np.r_[first, len(rare)]).astype(np.int32)
                edges = np.searchsorted(r_of[first], np.arange(hi - lo + 1)).astype(np.int32)
                id_edges = (2 * (words.first + np.arange(hi - lo + 1))).astype(np.int32)
                yield _batch(
                    key=row + np.arange(hi - lo),
                    doc_id=batch.column(0)[lo:hi], held_out=batch.column(1)[lo:hi], n_tokens=size + 1,
                    known=add(np.ones(len(token)), hit).astype(np.int64) + end_known, base=add(own, hit) + end_base, rest=add(own, hit & tails) + add(within[tail], tails),
                    ids=pa.BinaryArray.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(id_edges), pa.py_buffer(ids.tobytes())]),
                    rare=pa.ListArray.from_arrays(edges, r_token[first]), times=pa.ListArray.from_arrays(edges, times),
                )
                row += hi - lo

    return docs.select("doc_id", "held_out", "text").mapInArrow(encode, ENCODED)


def _sequences(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, their ids one after the other, how many each has), of at most BATCH_TOKENS, or one row."""
    for batch in batches:
        for lo, hi, data, offsets in texts_of(batch.column(column), 2 * BATCH_TOKENS):
            yield batch.slice(lo, hi - lo), data.view("<u2"), np.diff(offsets) // 2


def _round(sequences: DataFrame, network: Network, lanes: int, window: int) -> None:
    """Sets the network's values to the mean of what the tasks learn from their sequences (ids), each starting from the present ones."""
    names = list(network.p)
    shared = sequences.sparkSession.sparkContext.broadcast(network.p)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, steps, tokens = Network(SHAPE, {k: v.copy() for k, v in shared.value.items()}), {}, 0
        for _, ids, size in _sequences(batches, "ids"):
            own.learn(ids, size, steps, lanes, window)
            tokens += len(ids)
        if tokens:
            slices = np.array_split(np.concatenate([own.p[k].ravel() for k in names]).astype(np.float64) * tokens, SLICES)
            yield _batch(slice=np.arange(SLICES), tokens=np.full(SLICES, tokens), data=pa.array([x.tobytes() for x in slices], pa.binary()))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for i, tokens, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                known = sums.setdefault(i, [0, 0.0])
                known[0], known[1] = known[0] + tokens, known[1] + np.frombuffer(data)
        for i, (tokens, x) in sums.items():
            yield _batch(slice=np.array([i]), tokens=np.array([tokens]), data=pa.array([x.tobytes()], pa.binary()))

    schema = "slice long, tokens long, data binary"
    found = {r.slice: np.frombuffer(r.data) / r.tokens for r in sequences.mapInArrow(learn, schema).repartition(SLICES, "slice").mapInArrow(add, schema).collect()}
    if found:
        flat, at = np.concatenate([found[i] for i in range(SLICES)]).astype(np.float32), 0
        for k in names:
            size = network.p[k].size
            network.p[k] = flat[at : at + size].reshape(network.p[k].shape)
            at += size


def scored(docs: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", shares: int = SHARES, rounds: int = ROUNDS, lanes: int = LANES, window: int = WINDOW) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document; held_out ones (crc32 of the id, mod 5, is 1) teach nothing."""
    doc_id = F.col(id_col).cast("long")
    held_out = F.coalesce(id_bucket(doc_id, 5) == 1 if held_out is None else held_out, F.lit(False))
    own = docs.select(doc_id.alias("doc_id"), held_out.alias("held_out"), F.col(f"`{text_col}`").cast("string").alias("text"))
    table = written(token_counts(own.where("not held_out").select("text")), "lm_counts")
    counts = Counts(table)
    codes = written(encoded(own, counts), "lm_ids")
    network = counts.network()
    for k in range(rounds):
        _round(codes.where(~F.col("held_out") & (F.pmod(F.xxhash64("key"), F.lit(shares)) == k)).select("ids"), network, lanes, window)
    shared = docs.sparkSession.sparkContext.broadcast(network.p)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(SHAPE, shared.value)
        for batch, ids, size in _sequences(batches, "ids"):
            logs = np.add.reduceat(net.score(ids, size, lanes, window).astype(np.float64), np.cumsum(size) - size) / np.log(10)
            rest = np.asarray(batch.column("rest"))
            yield batch.drop_columns(["ids", "rest"]).append_column("score", pa.array(logs + rest))

    columns = "key long, doc_id long, held_out boolean, n_tokens long, known long, base double"
    found = codes.select(*[c.split()[0] for c in columns.split(", ")], "rest", "ids").mapInArrow(score, f"{columns}, score double")
    rare = codes.select("key", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("key", F.col("x.rare").alias("token"), F.col("x.times").alias("times"))
    rare = rare.join(table.select("token", "n"), "token", "left")
    one = F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(counts.divisor))
    sums = rare.groupBy("key").agg(F.sum(F.col("times") * one).alias("rare_base"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"))
    more = lambda c, x: F.col(c) + F.coalesce(x, F.lit(0))
    return found.join(sums, "key", "left").select(
        "doc_id", "held_out", "n_tokens", more("known", "rare_known").cast("long").alias("n_known"), F.lit(counts.total).cast("long").alias("train_tokens"), more("base", "rare_base").alias("base_score"), more("score", "rare_base").alias("score"),
    )
