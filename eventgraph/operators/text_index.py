"""A stored inverted index for BM25+: written once, added to, and searched without reading the texts again.

Layout. Documents get numbers, in spans of at most SPAN. A row of postings holds a token's documents of one span:
their numbers as differences and how often the token comes in each, with the largest count and the smallest length. Files are split by a hash of the token and sorted by token and span, so a
search reads the buckets and row groups of its tokens. A common token has many rows and no hot one.
Texts are shuffled once, by id; a span lies within a partition and is counted and packed there, so words are not shuffled.

Search. A row's best gain follows from its largest count and smallest length. The k best rows of a query
are scored first; the k-th best sum among their documents is a score that the result reaches at least.
A span whose rows' best gains do not add up to it is skipped for that query, since none of its documents can
be among the k best. The rows of the other spans are brought together span by span, packed as they are, and scored there
exactly for up to PASS queries at a time; k rows for each query and span leave it. Nothing is approximate.

Additions. ``add`` writes the postings of documents that are not there yet in spans of their own, with the
document table, in one commit; frequencies and the average length are sums over all rows, so
scores are those of one index built at once. Adding a batch again changes nothing.

Defined cases. Null text: a document of length 0. Rows with equal ids: one document with all their words.
Queries without a known token: no rows. Empty index: no rows. Null ids: a document like others.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventgraph.functions import text as tx
from eventgraph.operators.ordering import settled
from eventgraph.operators.scoring import DELTA, K1, PLACES, Asked, B, Leading, counted, gains
from eventgraph.sources.snapshots import Snapshots

#: Documents of a span (a power of two), and hash buckets of tokens.
SPAN, BUCKETS = 4096, 32
#: Queries that a span is scored for at a time, rows that are sent to all tasks at most, texts counted at a time, and the numbers of a partition.
PASS, SENT, BLOCK, NUMBERS = 2048, 100_000, 1024, 1 << 33
SCHEMAS = {
    "documents": "doc_no long, doc_id long, length long",
    "postings": "token string, span long, n int, max_tf int, min_length int, docs array<int>, tfs array<int>, bucket int",
    "totals": "n_docs long, n_tokens long",
}
#: Bounds are given this much, since scores are rounded.
_SLACK = 1e-6


def bucket(token: str | Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def gain(tf: Column, length: Column, average: Column) -> Column:
    """What a token adds to a document's score for each unit of its weight, beyond the baseline."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def _only(rows: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """The rows whose keys are among wanted's, which are sent to all tasks as far as they are few."""
    some = wanted.select(*keys).distinct()
    return rows.join(F.broadcast(some) if some.limit(SENT + 1).count() <= SENT else some, list(keys), "left_semi")


class _Span:
    """What is counted so far of a span's documents."""

    def __init__(self, number: int, size: int):
        self.number, self.size, self.ids, self.lengths, self.parts = number, size, [], np.zeros(size, np.int64), []

    def take(self, ids: list, texts: pa.Array, places: np.ndarray) -> None:
        """ids are those of documents that begin here."""
        self.ids += ids
        words, codes, docs, counts, lengths = counted(texts, places, self.size)
        self.lengths += lengths
        self.parts.append((words, codes * self.size + docs, counts))

    def rows(self) -> pa.RecordBatch:
        """The span's rows of postings, sorted by token, and one without a token for its documents."""
        words = pc.unique(pa.chunked_array([p[0] for p in self.parts], pa.string())).sort()
        codes = [pc.index_in(p[0], words).to_numpy()[p[1] // self.size] * np.int64(self.size) + p[1] % self.size for p in self.parts]
        keys, which = np.unique(np.concatenate(codes), return_inverse=True)
        tfs = np.bincount(which, np.concatenate([p[2] for p in self.parts]), len(keys)).astype(np.int32)
        docs, ends = (keys % self.size).astype(np.int32), np.searchsorted(keys // self.size, np.arange(len(words)), "right")
        lengths, begins = self.lengths[docs].astype(np.int32), np.concatenate([[0], ends])[:-1].astype(np.int64)
        steps = np.diff(docs, prepend=np.int32(0))
        steps[begins] = docs[begins]
        offsets = pa.array(np.concatenate([[0], ends, [len(docs)]]).astype(np.int32))
        only = lambda held: [None] * len(words) + [held]
        reduced = lambda f, x: f.reduceat(x, begins).tolist() if len(begins) else []
        columns = [
            pa.concat_arrays([words, pa.nulls(1, pa.string())]),
            pa.array([self.number] * (len(words) + 1), pa.int64()),
            pa.array([*np.diff(ends, prepend=0).tolist(), 0], pa.int32()),
            pa.array([*reduced(np.maximum, tfs), None], pa.int32()),
            pa.array([*reduced(np.minimum, lengths), None], pa.int32()),
            *[pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (steps, tfs)],
            pa.array(only(self.lengths[: len(self.ids)]), pa.list_(pa.int32())),
            pa.array(only(self.ids), pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(columns, ["token", "span", "n", "max_tf", "min_length", "docs", "tfs", "lengths", "ids"])


_PACKED = "token string, span long, n int, max_tf int, min_length int, docs array<int>, tfs array<int>, lengths array<int>, ids array<long>"


def _packer(first: int, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packs a partition of (doc_id, text), sorted by id, into spans; numbers begin at first, a multiple of size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins = (first + TaskContext.get().partitionId() * NUMBERS) // size
        span, place, last = None, -1, []
        for whole in batches:
            for begin in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(begin, BLOCK)
                ids = batch.column(0).to_pylist()
                new = np.array([[i] != last if n == 0 else i != ids[n - 1] for n, i in enumerate(ids)])
                places, last = place + np.cumsum(new), [ids[-1]]
                place = int(places[-1])
                for number in np.unique(places // size).tolist():
                    if span is None or span.number != begins + number:
                        if span is not None:
                            yield span.rows()
                        span = _Span(begins + number, size)
                    a, b = np.searchsorted(places, [number * size, (number + 1) * size])
                    span.take([i for i, one in zip(ids[a:b], new[a:b]) if one], batch.column(1).slice(a, b - a), places[a:b] - number * size)
        if span is not None:
            yield span.rows()

    return run


def _scorer(k: int, size: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Scores a span's rows, with one of its admitted documents, for a group of queries; gives (query_id, doc_id, score)."""

    def run(there: pa.Table, rows: pa.Table) -> pa.Table:
        asked, lists = Asked(rows), there.combine_chunks()
        best = Leading(len(asked.ids), k, pa.int64())
        whole = lists.filter(pc.is_null(lists.column("token"))).to_pylist()
        if whole and len(asked.ids):
            ids, offered, sizes = [None] * size, np.zeros(size, bool), np.zeros(size, np.int64)
            for doc, i, length in zip(whole[0]["docs"], whole[0]["ids"], whole[0]["lengths"]):
                ids[doc], offered[doc], sizes[doc] = i, True, length
            ids, lists = pa.array(ids, pa.int64()), lists.filter(pc.is_valid(lists.column("token"))).combine_chunks()
            steps, counts = (_flat(lists.column(c)) for c in ("docs", "tfs"))
            ends = np.cumsum(pc.list_value_length(lists.column("docs")).to_numpy().astype(np.int64))
            begins = np.concatenate([[0], ends])[:-1].astype(np.int64)
            upto = np.cumsum(steps)
            docs = upto - np.repeat(upto[begins] - steps[begins], ends - begins) if len(begins) else upto
            where = pc.index_in(asked.words, lists.column("token").combine_chunks())
            none = pc.is_null(where).to_numpy(zero_copy_only=False)
            at = pc.fill_null(where, 0).to_numpy()
            first, last = (np.where(none, 0, x[at]) if len(x) else np.zeros(len(at), np.int64) for x in (begins, ends))
            for query, places, sums in asked.scores(first, last, docs, gains(counts, sizes[docs], asked.average), offered):
                best.take(query, np.round(asked.base[query] + sums, PLACES), ids, places)
        return pa.Table.from_batches([best.rows(asked.ids)])

    return run


def _flat(lists: pa.ChunkedArray) -> np.ndarray:
    return lists.combine_chunks().flatten().to_numpy().astype(np.int64)


class TextIndex:
    """The index of a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.store = Snapshots(spark, folder, SCHEMAS, {"postings": ["bucket"]})

    def add(self, docs: DataFrame, text: str = "text") -> int:
        """Index the documents (doc_id and a text) whose ids are not there yet; returns the version."""
        there = self.store.read("documents").select(F.col("doc_id").alias("_id"))
        new = docs
        if not there.isEmpty():  # ids are compared before texts are moved
            fresh = settled(docs.select("doc_id").distinct().join(there, F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti").select(F.col("doc_id").alias("_id")))
            few = fresh.limit(SENT + 1).count() <= SENT
            new = docs.join(F.broadcast(fresh) if few else fresh, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
        first = int((self.store.latest()["info"] or {}).get("next", 0))
        dealt = new.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).repartition("doc_id").sortWithinPartitions("doc_id")
        path = f"{self.store.folder}/packed-{uuid.uuid4().hex}"  # numbers stay what they are; arrays of numbers are far smaller here than in a checkpoint
        dealt.mapInArrow(_packer(first, SPAN), _PACKED).write.parquet(path)
        packed = docs.sparkSession.read.schema(_PACKED).parquet(path)
        each = packed.where("token is null").select("span", F.posexplode(F.arrays_zip("lengths", "ids")).alias("place", "doc"))
        documents = each.select((F.col("span") * SPAN + F.col("place")).alias("doc_no"), F.col("doc.ids").alias("doc_id"), F.col("doc.lengths").cast("long").alias("length"))
        totals = documents.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_tokens"))
        last = packed.agg(F.max("span")).first()[0]
        following = first if last is None else (last + 1) * SPAN
        postings = packed.where("token is not null").drop("ids", "lengths").withColumn("bucket", bucket("token"))
        ranged = postings.repartitionByRange("bucket", "token", "span").sortWithinPartitions("bucket", "token", "span")
        return self.store.commit(append={"documents": documents, "postings": ranged, "totals": totals}, info={"next": str(following)})

    def blocks(self, queries: DataFrame, version: int | None = None) -> DataFrame:
        """(query_id, token, span, weight, average, base, best) of every row of postings that a query's tokens have; best bounds the gain of its documents."""
        asked = settled(queries.select("query_id", F.explode(tx.search_tokens(F.col("text"))).alias("token")).groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("qtf")))
        postings = self.store.read("postings", version).select("bucket", "token", "span", "n", "max_tf", "min_length")
        heads = settled(_only(postings, asked.withColumn("bucket", bucket("token")), "bucket", "token"))
        total = self.store.read("totals", version).agg(F.sum("n_docs").alias("n_docs"), (F.sum("n_tokens") / F.sum("n_docs")).alias("average"))
        weights = heads.groupBy("token").agg(F.sum("n").alias("df")).crossJoin(F.broadcast(total))  # one row
        known = asked.join(weights, "token").select("query_id", "token", (F.col("qtf") * F.log((F.col("n_docs") + 1) / F.col("df"))).alias("weight"), "average")
        known = known.withColumn("base", F.sum(F.col("weight") * DELTA).over(W.partitionBy("query_id")))
        best = F.col("weight") * gain(F.col("max_tf"), F.col("min_length"), F.col("average"))
        return heads.join(known, "token").select("query_id", "token", "span", "weight", "average", "base", best.alias("best"))

    def _best(self, blocks: DataFrame, k: int, version: int | None, documents: DataFrame) -> DataFrame:
        """(query_id, doc_id, score): the k best of documents (doc_no, doc_id, length) for each query and span, by the given rows of postings."""
        postings = self.store.read("postings", version)
        n = max(1, -(-blocks.select("query_id").distinct().count() // PASS))
        pairs = blocks.select(bucket("token").alias("bucket"), "token", "span")
        few = pairs.distinct().limit(SENT + 1).count() <= SENT
        held = _only(postings, pairs, *(("bucket", "token", "span") if few else ("bucket", "token")))
        held = held.select("token", "span", "docs", "tfs", F.lit(None).cast("array<int>").alias("lengths"), F.lit(None).cast("array<long>").alias("ids"))
        ids = documents.groupBy(F.floor(F.col("doc_no") / SPAN).alias("span")).agg(F.collect_list(F.struct((F.col("doc_no") % SPAN).cast("int").alias("doc"), "doc_id", F.col("length").cast("int").alias("length"))).alias("all"))
        ids = _only(ids, blocks, "span").select(F.lit(None).cast("string").alias("token"), "span", F.col("all.doc").alias("docs"), F.lit(None).cast("array<int>").alias("tfs"), F.col("all.length").alias("lengths"), F.col("all.doc_id").alias("ids"))
        there = held.unionByName(ids).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        rows = blocks.select("span", F.pmod(F.xxhash64("query_id"), F.lit(n)).cast("int").alias("group"), "query_id", "token", "weight", "average", "base")
        schema = f"query_id {blocks.schema['query_id'].dataType.simpleString()}, doc_id long, score double"
        return there.groupBy("span", "group").cogroup(rows.groupBy("span", "group")).applyInArrow(_scorer(k, SPAN), schema)

    def candidates(self, blocks: DataFrame, k: int, version: int | None = None, admitted: DataFrame | None = None) -> DataFrame:
        """The rows of blocks that lie in spans which can hold one of a query's k best documents."""
        documents = self.store.read("documents", version) if admitted is None else admitted
        top = W.partitionBy("query_id").orderBy(F.desc("best"), "token", "span")
        seeds = settled(blocks.withColumn("_k", F.row_number().over(top)).where(F.col("_k") <= k).drop("_k"))
        order = W.partitionBy("query_id").orderBy(F.desc("score"))
        reached = self._best(seeds, k, version, documents).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= k)
        floors = reached.where(F.col("_k") == k).select("query_id", F.col("score").alias("floor"))
        spans = blocks.groupBy("query_id", "span").agg((F.first("base") + F.sum("best")).alias("most")).join(floors, "query_id", "left")
        alive = settled(spans.where(F.col("floor").isNull() | (F.col("most") >= F.col("floor") - _SLACK)).select("query_id", "span"))
        return blocks.join(alive, ["query_id", "span"], "left_semi")

    def search(self, queries: DataFrame, k: int, admitted: DataFrame | None = None, version: int | None = None) -> DataFrame:
        """(query_id, doc_id, score, rank): the k best documents of each query (query_id, text), ties in order of doc_id.

        Only documents of admitted (doc_id) are found, if it is given; frequencies and the average length
        stay those of all. A ranking that is too short is filled with documents that match no word.
        """
        documents = self.store.read("documents", version)
        if k <= 0:
            return queries.select("query_id", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("rank")).where(F.lit(False))
        if admitted is not None:
            documents = settled(documents.join(admitted.select("doc_id"), "doc_id", "left_semi"))
        blocks = settled(self.blocks(queries, version))
        base = blocks.groupBy("query_id").agg(F.first("base").alias("base"))
        scored = self._best(self.candidates(blocks, k, version, documents), k, version, documents)
        best = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        top = settled(scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))
        short = base.join(top.groupBy("query_id").agg(F.count(F.lit(1)).alias("have")), "query_id", "left").where(F.coalesce("have", F.lit(0)) < k)
        first = documents.select("doc_id").orderBy("doc_id").limit(k)
        fill = short.crossJoin(F.broadcast(first)).join(top.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")  # k rows
        both = top.select("query_id", "doc_id", "score").unionByName(fill.select("query_id", "doc_id", F.round("base", PLACES).alias("score")))
        return both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
