"""Masked pseudo-likelihood of texts under a bidirectional window network, trained in numpy.

Tokens are UTF-8 bytes. The network predicts a byte from the two bytes on either side of it (byte 0
stands beyond a text's ends): embeddings, one tanh layer, a softmax over 256. A text's score is the
sum over all its bytes of the log-probability of the byte given both sides.

Training. All texts are counted: every task adds up the five-byte windows of its part and sends each
distinct one once, with its count; Spark sums them. The windows are dealt by hash into parts of about
PART windows; each part trains a copy of the network on all its windows, weighted by their counts, in
seeded order (several times over where they are fewer than DRAWS). Spark averages the copies, number
by number, in proportion to their windows' counts, and that is repeated for ROUNDS. Only the averaged
weights, about 11,000 numbers at any size, reach the driver.

Scoring. A text's windows are looked up by their code; the network is run once for each distinct
window that a task meets, so time is linear in the text and hardly depends on the network.

Defined cases. Null and empty texts: no bytes, sum 0.0, mean null. Very long texts: whole; a task
holds the codes of one text at least. Repeated rows count as often as they are there and get equal
scores. Null ids: scored. Empty table: no rows. Extra columns are dropped by the query, kept by
``scored`` but for those with the name of an added one, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventgraph.llm.common import arrow_map, columns_of, reliable, small_batches, utf8_views, without

SIDE = 2
EMBED, HIDDEN = 8, 32
ROUNDS, DRAWS, BATCH, RATE, SEED = 3, 150_000, 512, 0.004, 5
PART, LEAST_PARTS = 500_000, 6
#: Codes that are counted, or scores that are kept, at once in a task.
AT_ONCE, KEPT = 4_000_000, 2_000_000
Weights = list[np.ndarray]


def codes_of(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the five-byte windows around every byte of the texts, and where each text begins."""
    sizes = np.array([len(t) for t in texts], np.int64)
    gap = np.zeros(SIDE, np.uint8)
    joined = np.concatenate([gap, *(part for t in texts for part in (t, gap))])
    n = len(joined) - 2 * SIDE
    codes = np.zeros(max(n, 0), np.int64)
    for k in range(2 * SIDE + 1):
        codes <<= 8
        codes |= joined[k : k + n]
    at = np.cumsum(sizes + SIDE) - sizes - SIDE
    inside = np.ones(len(codes), bool)
    for k in range(SIDE):  # windows around the gaps themselves
        ends = at + sizes + k
        inside[ends[ends < len(codes)]] = False
    return codes[inside], np.cumsum(sizes) - sizes


def fresh(seed: int = SEED) -> Weights:
    r = np.random.default_rng(seed)
    return [w.astype("f4") for w in (r.normal(0, 0.3, (256, EMBED)), r.normal(0, 0.25, (2 * SIDE * EMBED, HIDDEN)), np.zeros(HIDDEN), r.normal(0, 0.1, (HIDDEN, 256)), np.zeros(256))]


def split(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours (n, 2 * SIDE) and middle bytes of windows."""
    places = np.stack([(codes >> (8 * k)) & 255 for k in range(2 * SIDE, -1, -1)], 1)
    return np.delete(places, SIDE, 1), places[:, SIDE]


def log_probability(weights: Weights, codes: np.ndarray) -> np.ndarray:
    embed, w1, b1, w2, b2 = weights
    out = np.empty(len(codes))
    for s in range(0, len(codes), 4096):
        sides, middle = split(codes[s : s + 4096])
        logits = np.tanh(embed[sides].reshape(len(sides), -1) @ w1 + b1) @ w2 + b2
        logits -= logits.max(1, keepdims=True)
        out[s : s + 4096] = logits[np.arange(len(sides)), middle] - np.log(np.exp(logits).sum(1))
    return out


def batches(counts: np.ndarray, draws: int, r: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of windows and their weights, in batches of equal weight and about BATCH windows.

    A pass gives each window exactly its count, over as many batches as it takes; passes are made until
    draws windows are read, one at least.
    """
    ends = np.linspace(0, int(counts.sum()), -(-len(counts) // BATCH) + 1).astype(np.int64)
    for _ in range(max(1, -(-draws // len(counts)))):
        order = r.permutation(len(counts))
        upto = np.cumsum(counts[order])
        for low, high in zip(ends[:-1], ends[1:]):
            at = np.arange(np.searchsorted(upto, low, side="right"), np.searchsorted(upto, high) + 1)
            yield order[at], np.minimum(upto[at], high) - np.maximum(upto[at] - counts[order[at]], low)


def trained(weights: Weights, codes: np.ndarray, counts: np.ndarray, draws: int, seed: int, rate: float = RATE) -> Weights:
    """Adam on all the windows, weighted by their counts."""
    weights = [w.copy() for w in weights]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for t, (at, n_each) in enumerate(batches(counts, draws, np.random.default_rng(seed)), 1):
        embed, w1, b1, w2, b2 = weights
        sides, middle = split(codes[at])
        n = len(sides)
        x = embed[sides].reshape(n, -1)
        h = np.tanh(x @ w1 + b1)
        logits = h @ w2 + b2
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(n), middle] -= 1
        p *= (n_each / n_each.sum()).astype("f4")[:, None]
        dh = (p @ w2.T) * (1 - h * h)
        g_embed = np.zeros_like(embed)
        np.add.at(g_embed, sides.ravel(), (dh @ w1.T).reshape(-1, EMBED))
        for w, g, m, v in zip(weights, (g_embed, x.T @ dh, dh.sum(0), h.T @ p, p.sum(0)), first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)).astype("f4")
    return weights


def window_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(code, n): how often each window is in all the texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting: list[np.ndarray] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            new, n = np.unique(np.concatenate(waiting), return_counts=True)
            waiting.clear()
            both, at = np.unique(np.concatenate([codes, new]), return_inverse=True)
            sums = np.zeros(len(both), np.int64)
            np.add.at(sums, at, np.concatenate([counts, n]))
            return both, sums

        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                waiting.append(codes_of(list(utf8_views(batch.column(0).slice(s, 256))))[0])
                if sum(map(len, waiting)) >= AT_ONCE:
                    codes, counts = merged()
        if waiting:
            codes, counts = merged()
        for s in range(0, len(codes), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(codes[s : s + 50_000]), pa.array(counts[s : s + 50_000])], ["code", "n"])

    return small_batches(docs.select(text)).mapInArrow(work, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _part_trainer(start: Weights, draws: int, seed: int, rate: float):
    def one(group: pd.DataFrame) -> pd.DataFrame:
        part, group = int(group["part"].iloc[0]), group.sort_values("code")
        own = trained(start, group["code"].to_numpy(), group["n"].to_numpy(), draws, seed + part, rate)
        return pd.DataFrame({"part": [part], "n": [int(group["n"].sum())], "w": [np.concatenate([w.ravel() for w in own])]})

    return one


def train(docs: DataFrame, text: str = "text", rounds: int = ROUNDS, draws: int = DRAWS, seed: int = SEED) -> Weights:
    """Weights trained on the windows of all texts."""
    columns_of(docs, text)
    counts = reliable(window_counts(docs, text))
    weights, n = fresh(seed), counts.count()
    if n == 0:
        return weights
    parts = max(LEAST_PARTS, -(-n // PART))
    dealt = counts.withColumn("part", F.pmod(F.xxhash64("code"), F.lit(parts)).cast("int"))
    for k in range(rounds):
        one = _part_trainer(weights, draws, seed * 1000 + k * 100, RATE / (1 + k))
        copies = dealt.groupBy("part").applyInPandas(one, "part int, n long, w array<float>")
        numbers = copies.select("n", F.posexplode("w").alias("at", "w"))
        # decimals, so that the order of adding does not matter
        mean = F.sum((F.col("n") * F.col("w").cast("double")).cast("decimal(38,8)")).cast("double") / F.sum("n")
        averaged = numbers.groupBy("at").agg(mean.alias("w")).orderBy("at").collect()
        mean = np.array([r["w"] for r in averaged], "f4")
        cuts = np.cumsum([w.size for w in weights])[:-1]
        weights = [w.reshape(old.shape) for w, old in zip(np.split(mean, cuts), weights)]
    return weights


class Scorer:
    """Log-probabilities by window; those that were asked for are kept, up to a bound."""

    def __init__(self, weights: Weights):
        self.weights, self.codes, self.values = weights, np.zeros(0, np.int64), np.zeros(0)

    def __call__(self, texts: list[np.ndarray]) -> list[float]:
        codes, begins = codes_of(texts)
        if not len(codes):
            return [0.0] * len(texts)
        distinct, at = np.unique(codes, return_inverse=True)
        place = np.searchsorted(self.codes, distinct)
        new = distinct[self.codes[np.minimum(place, len(self.codes) - 1)] != distinct] if len(self.codes) else distinct
        if len(new):
            if len(self.codes) + len(new) > KEPT:
                self.codes, self.values, new = self.codes[:0], self.values[:0], distinct
            codes_, values = np.concatenate([self.codes, new]), np.concatenate([self.values, log_probability(self.weights, new)])
            order = np.argsort(codes_)
            self.codes, self.values = codes_[order], values[order]
        each = self.values[np.searchsorted(self.codes, distinct)][at]
        ends = np.r_[begins[1:], len(codes)]
        return [float(each[b:e].sum()) for b, e in zip(begins, ends)]


def scored(docs: DataFrame, weights: Weights, text: str = "text") -> DataFrame:
    """docs without its text, with n_tokens and the sum of conditional log-probabilities."""
    columns_of(docs, text)
    docs = without(docs, "n_tokens", "log_likelihood")
    kept = [f for f in docs.schema.fields if f.name != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n_tokens long, log_likelihood double"])
    made: list[Scorer] = []

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        scorer = made[0] if made else made.append(Scorer(weights)) or made[0]
        column = batch.column(batch.schema.get_field_index(text))
        texts = list(utf8_views(column))
        others = [i for i in range(batch.num_columns) if batch.schema.names[i] != text]
        arrays = [pa.array([len(t) for t in texts], pa.int64()), pa.array(scorer(texts), pa.float64())]
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in others), *arrays], [*(batch.schema.names[i] for i in others), "n_tokens", "log_likelihood"])

    return arrow_map(docs, work, schema)


def op8_pseudo_likelihood(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    found = scored(docs, train(docs))
    return found.select("doc_id", "n_tokens", F.round("log_likelihood", 4).alias("log_likelihood"), F.round(F.try_divide("log_likelihood", F.col("n_tokens")), 6).alias("mean_log_likelihood"))
