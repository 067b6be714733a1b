"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are read in chunks of CHUNK bytes, each STRIDE after the last, so that they
overlap and cover the whole text. In a chunk every filter (WIDTH neighbouring bytes, each embedded)
is evaluated at every position and max-pooled; over the chunks the pooled values' maximum, mean and
minimum go into one logistic output. Scoring is linear in a text's length and keeps a few chunks in
memory at a time.

Fit. On at most ``sample`` labelled documents (a third of them of label 0, if there are as many) and
BYTES bytes. Documents are taken in order of a hash of the id; one that does not fit into what is left
of the bytes is passed over, and the next ones are taken all the same. Of each its whole text, all chunks. Only rows outside the held-out fold (crc32 of the id as text, modulo FOLDS, is 0) are
read for it, and only text and label. The sample is the only thing that the driver ever holds.

Defined cases. Null and empty texts: scored as one chunk of padding. Null label or id: not used for
the fit, scored all the same (a null id is held out). Ids with several labels: the lowest counts.
Without labels of both kinds every score is the share of label 1, or 0.5. Empty table: no rows. Extra
columns stay; one with the name of the score is replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventgraph.llm.common import arrow_map, columns_of, reliable, utf8_views, without

CHUNK, STRIDE, WIDTH, FILTERS, DEPTH = 512, 384, 5, 16, 8
FOLDS, THRESHOLD = 5, 0.3
SAMPLE, BYTES, EPOCHS, BATCH, RATE, SEED = 1800, 32 << 20, 14, 32, 0.01, 11
#: Chunks that are evaluated at once.
BLOCK = 128


@dataclass
class Network:
    """Weights: byte embedding, filters, their offsets and the output layer."""

    embed: np.ndarray
    filters: np.ndarray
    offset: np.ndarray
    out: np.ndarray
    bias: float

    @classmethod
    def fresh(cls, seed: int) -> Network:
        r = np.random.default_rng(seed)
        return cls(r.normal(0, 0.5, (256, DEPTH)).astype("f4"), r.normal(0, 0.5, (WIDTH, DEPTH, FILTERS)).astype("f4"), np.zeros(FILTERS, "f4"), r.normal(0, 0.1, 3 * FILTERS).astype("f4"), 0.0)

    def tables(self) -> np.ndarray:
        """What a byte at each place of a filter adds: (WIDTH, 256, FILTERS)."""
        return np.stack([self.embed @ w for w in self.filters])

    def pooled(self, chunks: np.ndarray, tables: np.ndarray, places: bool = False):
        """Max over positions of each filter, (chunks, FILTERS), and where it is if asked; BLOCK chunks at a time."""
        n = chunks.shape[1] - WIDTH + 1
        tops, at = np.empty((len(chunks), FILTERS), "f4"), np.empty((len(chunks), FILTERS), np.int64) if places else None
        for s in range(0, len(chunks), BLOCK):
            part = chunks[s : s + BLOCK]
            act = tables[0].take(part[:, :n], axis=0)
            for k in range(1, WIDTH):
                act += tables[k].take(part[:, k : k + n], axis=0)
            if places:
                at[s : s + BLOCK] = best = act.argmax(1)
                tops[s : s + BLOCK] = np.take_along_axis(act, best[:, None, :], 1)[:, 0]
            else:
                tops[s : s + BLOCK] = act.max(1)
        return tops, at

    def score(self, data: np.ndarray, tables: np.ndarray) -> float:
        """Probability of label 1 for a whole text."""
        most, least, total, seen = None, None, 0.0, 0
        n = n_chunks(len(data))
        for first in range(0, n, BLOCK):
            h = np.maximum(self.pooled(cut(data, np.arange(first, min(n, first + BLOCK))), tables)[0] + self.offset, 0)
            top, low = h.max(0), h.min(0)
            most, least = (top, low) if most is None else (np.maximum(most, top), np.minimum(least, low))
            total, seen = total + h.sum(0, dtype="f8"), seen + len(h)
        logit = float(np.concatenate([most, total / seen, least]) @ self.out) + self.bias
        return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def n_chunks(size: int) -> int:
    """Chunks that cover a text of so many bytes; one for an empty text."""
    return 1 if size <= CHUNK else 1 + -(-(size - CHUNK) // STRIDE)


def cut(data: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The chunks of a text with the given numbers, padded with 0."""
    end = int(which[-1]) * STRIDE + CHUNK
    start = int(which[0]) * STRIDE
    own = data[start:end]
    if len(own) < end - start:
        own = np.concatenate([own, np.zeros(end - start - len(own), np.uint8)])
    return own[(which - which[0])[:, None] * STRIDE + np.arange(CHUNK)]


def fit(texts: list[bytes], labels: list[int], seed: int = SEED) -> Network:
    """Weights by Adam on the cross-entropy of mini-batches, in a seeded order."""
    net, y = Network.fresh(seed), np.array(labels, "f4")
    if len(set(labels)) < 2:
        share = float(y.mean()) if len(y) else 0.5
        net.out[:] = 0
        net.bias = float(np.clip(np.log(share / (1 - share)), -9, 9)) if 0 < share < 1 else 9.0 * (2 * share - 1)
        return net
    chunks, owner = [], []
    for i, text in enumerate(texts):
        data = np.frombuffer(text, np.uint8)
        n = n_chunks(len(data))
        chunks.append(cut(data, np.arange(n)))
        owner += [i] * n
    chunks, owner = np.concatenate(chunks), np.array(owner)
    begins = np.searchsorted(owner, np.arange(len(texts) + 1))
    params = [net.embed, net.filters, net.offset, net.out, np.zeros(1, "f4")]
    params[4][0] = float(np.log(y.mean() / (1 - y.mean())))
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    r, t = np.random.default_rng(seed), 0
    for epoch in range(EPOCHS):
        order = r.permutation(len(texts))
        for s in range(0, len(order), BATCH):
            rows = order[s : s + BATCH]
            own = np.concatenate([np.arange(begins[i], begins[i + 1]) for i in rows])
            n_of = begins[rows + 1] - begins[rows]
            starts = np.cumsum(n_of) - n_of
            best, at = net.pooled(chunks[own], net.tables(), places=True)
            pre = best + net.offset
            h = np.maximum(pre, 0)
            most, least, mean = np.maximum.reduceat(h, starts), np.minimum.reduceat(h, starts), np.add.reduceat(h, starts) / n_of[:, None]
            features = np.concatenate([most, mean, least], 1)
            p = 1 / (1 + np.exp(-np.clip(features @ net.out + params[4][0], -30, 30)))
            d = ((p - y[rows]) / len(rows)).astype("f4")
            g_out = features.T @ d
            df = d[:, None] * net.out[None, :]
            doc = np.repeat(np.arange(len(rows)), n_of)
            top, low = h == most[doc], h == least[doc]
            g = (df[doc, :FILTERS] * top / np.add.reduceat(top, starts).clip(1)[doc] + df[doc, FILTERS : 2 * FILTERS] / n_of[doc, None] + df[doc, 2 * FILTERS :] * low / np.add.reduceat(low, starts).clip(1)[doc]) * (pre > 0)
            g = g.astype("f4")
            g_embed, g_filters = 1e-4 * net.embed, np.empty_like(net.filters)
            which, f = np.arange(len(own))[:, None], np.arange(FILTERS)[None, :]
            for k in range(WIDTH):
                table = np.zeros((256, FILTERS), "f4")
                np.add.at(table, (chunks[own][which, at + k], np.broadcast_to(f, at.shape)), g)
                g_embed = g_embed + table @ net.filters[k].T
                g_filters[k] = net.embed.T @ table + 1e-4 * net.filters[k]
            t += 1
            rate = RATE * (1 - t / (EPOCHS * -(-len(texts) // BATCH) + 1)) + 1e-4
            for param, grad, m, v in zip(params, (g_embed, g_filters, g.sum(0), g_out + 1e-3 * net.out, np.array([d.sum()])), first, second):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                param -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype("f4")
    net.bias = float(params[4][0])
    return net


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "quality") -> Network:
    """A network fitted on at most sample labelled rows outside the held-out fold.

    A row of label 0 and one of label 1 are told apart by text alone; ids, languages and sources are not read.
    """
    columns_of(labels, f"doc_id {label}")
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).alias("_label")).where(~held_out())
    order = [F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id"]
    bad = known.where("_label = 0").orderBy(*order).limit(sample // 3)
    good = known.where("_label = 1").orderBy(*order).limit(sample - sample // 3)
    chosen = bad.unionByName(good)  # at most sample ids: a proven bound
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id").orderBy(*order).limit(sample)
    rows = reliable(rows.select("doc_id", "text", F.sha2("text", 256).alias("_digest"), F.octet_length("text").cast("long").alias("_size"), F.col("_label").cast("int").alias("_label"), F.md5(F.col("doc_id").cast("string").cast("binary")).alias("_order")))
    left, fitting = BYTES, set()
    for x in sorted(rows.select("_order", "_digest", "_size").collect()):  # at most sample rows
        if x["_size"] <= left:
            left -= x["_size"]
            fitting.add((x["_order"], x["_digest"]))
    some = docs.sparkSession.createDataFrame(sorted(fitting), "_order string, _digest string")
    rows = rows.join(F.broadcast(some), ["_order", "_digest"])
    rows = sorted((str(x["doc_id"]), bytes(x["text"]), x["_label"]) for x in rows.select("doc_id", "text", "_label").collect())
    return fit([x[1] for x in rows], [x[2] for x in rows])


def scored(docs: DataFrame, net: Network, text: str = "text", into: str = "score") -> DataFrame:
    """docs with the probability of label 1 of each whole text."""
    columns_of(docs, text)
    docs = without(docs, into)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"{into} double"])
    tables = net.tables()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [net.score(d, tables) for d in utf8_views(batch.column(batch.schema.get_field_index(text)))]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, into])

    return arrow_map(docs, work, schema)


def op4_quality_classifier(spark, folder: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    net = train(docs, labels)
    result = scored(docs.select("doc_id", "text"), net)
    return result.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))
