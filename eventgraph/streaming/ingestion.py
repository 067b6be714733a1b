"""Corpus files to stored chunks as they arrive, each batch once, with its manifest.

A batch's rows, a row about it and its number become visible in one commit of a snapshot store. Spark
repeats a batch that was under way when a run was stopped; a batch whose number is committed already is left alone, so
every file's rows are there once, wherever the run was stopped: before, in or after a commit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from eventgraph.operators import ingest
from eventgraph.sources.snapshots import Snapshots

CHUNKS = "doc_id string, chunk_index int, chunk_id string, prev_chunk_id string, next_chunk_id string, text string, raw_text string"
MANIFESTS = "batch long, n_documents long, documents_hash string"
SCHEMAS = {"chunks": CHUNKS, "manifests": MANIFESTS}
Sink = Callable[[DataFrame, int], None]


def once(store: Snapshots, table: str, work: Callable[[DataFrame], DataFrame]) -> Sink:
    """A foreachBatch function that commits work(batch) to a table together with a manifest of the batch."""
    last = f"{table}.batch"

    def sink(batch: DataFrame, number: int) -> None:
        if number <= int((store.latest()["info"] or {}).get(last, -1)):
            return  # this batch was committed before the run was stopped
        digest = F.coalesce(F.sum(F.xxhash64(*batch.columns).cast("decimal(38,0)")).cast("string"), F.lit("0"))
        told = batch.agg(F.lit(number).cast("long").alias("batch"), F.count(F.lit(1)).alias("n_documents"), digest.alias("documents_hash"))
        store.commit(append={table: work(batch), "manifests": told}, info={last: str(number)})

    return sink


def to_chunks(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, title, text) as chunks behind their titles; null texts and titles are empty."""
    clean = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))
    return ingest.chunks(clean.withColumn("header", F.concat(F.lit("Title: "), "title"))).select(*[c.split()[0] for c in CHUNKS.split(", ")])


def run(stream: DataFrame, store: Snapshots, checkpoint: str, sink: Sink | None = None) -> StreamingQuery:
    """Ingest all that has arrived and end; started again with the same checkpoint, it goes on where it was stopped."""
    sink = sink or once(store, "chunks", to_chunks)
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
