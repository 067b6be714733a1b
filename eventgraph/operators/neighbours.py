"""Nearest vectors by cosine similarity: all of them in passes, or through an inverted file of centroids.

Exact. Queries are taken in passes of at most PASS, each sent to all tasks; a task keeps the k best rows of each
query while it reads its vectors once. Vectors are not shuffled; k rows a query and task are.

Inverted file. Centroids are fitted (spherical k-means) on at most SAMPLE vectors, the first in order of a hash of
the id; every vector is then filed under its nearest ``copies`` centroids. A query looks into the lists of its ``probes``
nearest centroids only, and what lies there is compared exactly. A list is dealt into parts of about PART rows, and
the queries of a list into groups of PASS, so that a list with a third of all vectors, or asked by a third
of all queries, is many small tasks.

Defined cases. Null vectors and vectors of length 0 or that are no numbers: neither found nor asked. Equal scores: in
order of id. Fewer vectors than k, or than centroids: all that there are. Empty tables: no rows. Repeated rows:
each a row of its own in the exact search; rows of the inverted file with equal ids are one, its best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventgraph.operators.ordering import settled
from eventgraph.sources.snapshots import Snapshots

PLACES = 9
#: Queries of a pass, vectors of a part of a list, vectors that centroids are fitted on, rounds of fitting.
PASS, PART, SAMPLE, ROUNDS = 2048, 8192, 20_000, 12


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one size as unit rows; what has no direction becomes a row of nulls."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))
    size = np.sqrt((rows * rows).sum(1))
    return np.divide(rows, size[:, None], out=np.full_like(rows, np.nan), where=size[:, None] > 0)


def usable(df: DataFrame, size: int | None = None) -> DataFrame:
    """The rows whose vector has a direction: numbers only, not all zero."""
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vector", lambda x: x != 0)
    return df.where(F.coalesce(sound & (F.size("vector") == size if size else F.lit(True)), F.lit(False)))


class _Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.ids = k, [np.zeros(0)] * n, [np.zeros(0, np.int64)] * n

    def take(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores[query], scores]), np.concatenate([self.ids[query], ids])
        if len(scores) > self.k:
            least = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            near = np.flatnonzero(scores >= least)  # with all that tie at the end
            near = near[np.lexsort((ids[near], -scores[near]))][: self.k]
            scores, ids = scores[near], ids[near]
        self.scores[query], self.ids[query] = scores, ids

    def rows(self, queries: pa.Array) -> pa.RecordBatch:
        n = [len(s) for s in self.scores]
        which = pa.array(np.repeat(np.arange(len(n)), n))
        return pa.RecordBatch.from_arrays([queries.take(which), pa.array(np.concatenate([np.zeros(0, np.int64), *self.ids])), pa.array(np.concatenate([np.zeros(0), *self.scores]))], ["query_id", "id", "score"])


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): the k nearest of vectors (id, vector) for each of queries (query_id, vector)."""
    asked = usable(queries.select(F.col("query_id").cast("long"), "vector"))
    n = max(1, -(-asked.count() // PASS))
    found = None
    for number in range(n):
        own = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == number).toArrow().combine_chunks()  # about PASS rows
        ids, unit = own.column(0).combine_chunks(), _matrix(own.column(1).combine_chunks()) if own.num_rows else np.zeros((0, 0))

        def run(batches: Iterator[pa.RecordBatch], ids=ids, unit=unit) -> Iterator[pa.RecordBatch]:
            best = _Best(len(ids), k)
            for batch in batches:
                if batch.num_rows and len(ids):
                    scores = np.round(unit @ _matrix(batch.column(1)).T, PLACES)
                    own = batch.column(0).to_numpy()
                    for q in range(len(ids)):
                        best.take(q, scores[q], own)
            yield best.rows(ids)

        part = usable(vectors.select(F.col("id").cast("long"), "vector"), unit.shape[1] or None).mapInArrow(run, "query_id long, id long, score double")
        found = part if found is None else found.unionByName(part)
    return _ranked(found, k)


def centroids(vectors: DataFrame, n: int, sample: int = SAMPLE) -> np.ndarray:
    """n unit centroids, or as many as there are different vectors among the sample."""
    some = usable(vectors).orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toArrow().combine_chunks()
    if not some.num_rows:
        return np.zeros((0, 0))
    points = np.unique(_matrix(some.column(0).combine_chunks()), axis=0)
    centres = points[np.random.default_rng(5).permutation(len(points))[:n]]
    for _ in range(ROUNDS):
        nearest = (points @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        size = np.sqrt((sums * sums).sum(1))
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-300)[:, None], centres)
    return centres


class Neighbours:
    """An inverted file of vectors in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        schemas = {"vectors": "id long, vector array<float>, list int", "centroids": "list int, vector array<double>"}
        self.spark, self.store = spark, Snapshots(spark, folder, schemas, {"vectors": ["list"]})

    def _nearest(self, rows: DataFrame, key: str, n: int, centres: np.ndarray) -> DataFrame:
        """(key, vector, lists): the numbers of the n nearest centroids."""
        kind = rows.schema["vector"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                near = np.argsort(-(_matrix(batch.column(1)) @ centres.T), axis=1, kind="stable")[:, :n] if batch.num_rows else np.zeros((0, n), np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.tolist(), pa.list_(pa.int32()))], [key, "vector", "lists"])

        return usable(rows.select(F.col(key).cast("long"), "vector"), centres.shape[1]).mapInArrow(run, f"{key} long, vector {kind}, lists array<int>")

    def build(self, vectors: DataFrame, lists: int, copies: int = 1) -> int:
        """File every vector (id, vector) under the nearest copies of so many centroids; returns the version."""
        centres = centroids(vectors, lists)
        told = self.spark.createDataFrame([(i, c) for i, c in enumerate(centres.tolist())], self.store.schemas["centroids"])
        filed = self._nearest(vectors, "id", copies, centres).select("id", F.col("vector").cast("array<float>").alias("vector"), F.explode("lists").alias("list"))
        return self.store.commit(replace={"vectors": filed, "centroids": told})

    def search(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """(query_id, id, score, rank): the k nearest of the vectors in the lists of each query's nearest centroids."""
        centres = np.array([r["vector"] for r in self.store.read("centroids").orderBy("list").collect()])  # as many as were asked for
        if not len(centres):
            return exact(queries.limit(0), self.store.read("vectors"), k)
        asked = settled(self._nearest(queries, "query_id", probes, centres).select("query_id", F.col("vector").alias("asked"), F.explode("lists").alias("list")))
        held = self.store.read("vectors")
        parts = lambda rows, size: F.greatest(F.lit(1), F.ceil(rows / size)).cast("int")
        n = held.groupBy("list").agg(parts(F.count(F.lit(1)), PART).alias("n_parts")).join(asked.groupBy("list").agg(parts(F.count(F.lit(1)), PASS).alias("n_groups")), "list")
        n = settled(n)  # a row a list
        some = held.join(F.broadcast(n), "list").select("list", F.pmod(F.xxhash64("id"), F.col("n_parts")).alias("part"), F.explode(F.sequence(F.lit(0), F.col("n_groups") - 1)).alias("group"), "id", "vector")
        ones = asked.join(F.broadcast(n), "list").select("list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_parts").cast("long") - 1)).alias("part"), F.pmod(F.xxhash64("query_id"), F.col("n_groups")).cast("int").alias("group"), "query_id", "asked")

        def compare(there: pa.Table, own: pa.Table) -> pa.Table:
            best = _Best(own.num_rows, k)
            ids = own.column("query_id").combine_chunks()
            if own.num_rows and there.num_rows:
                unit = _matrix(own.column("asked").combine_chunks())
                for chunk in there.to_batches(2048):
                    scores = np.round(unit @ _matrix(chunk.column("vector")).T, PLACES)
                    for q in range(own.num_rows):
                        best.take(q, scores[q], chunk.column("id").to_numpy())
            return pa.Table.from_batches([best.rows(ids)])

        by = ["list", "part", "group"]
        found = some.groupBy(*by).cogroup(ones.groupBy(*by)).applyInArrow(compare, "query_id long, id long, score double")
        return _ranked(found.groupBy("query_id", "id").agg(F.max("score").alias("score")), k)  # found in several lists: once
