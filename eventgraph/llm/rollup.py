"""Token counts as rollups that signed deltas maintain.

A delta is a row (source, language, tokenizer, sign, n_tokens): an insert has sign 1, a delete -1, a
revised count is a delete of the old and an insert of the new one, under its tokenizer version.
Totals are additive, so a batch of deltas is summed by key first and only sums are stored.

Totals are maintained. A commit sums its batch by key, takes off what the same batch committed before,
and adds the difference to the totals; sums of the batch, difference and new totals become visible in
one commit of a snapshot store. So a batch that comes again, after a failure or twice by mistake, changes nothing, one
that comes again with other rows, or none, replaces what it said, and reading totals reads one row a key
however many batches there were. ``close`` forgets the sums of old batches; those then count as they stand and are not taken again.
``commit`` fits ``foreachBatch``, whose batch ids come again after a restart. Batches may arrive in any order.

Defined cases. Null source or language: a key of its own. Null or missing counts count 0 tokens and
one document. Null sign: an insert. Repeated rows are repeated changes. An empty batch
changes nothing; one that comes again empty takes back what it said. Extra columns are ignored. Keys whose documents and tokens are both back at 0 are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventgraph.llm.common import WORD, columns_of, reliable, shared_folder, spread_join, text_or_empty
from eventgraph.sources.snapshots import Snapshots

KEYS, SUMS = ("source", "language", "tokenizer"), ("n_docs", "n_tokens")
_KEYED = "source string, language string, tokenizer string, n_docs long, n_tokens long"
SCHEMAS = {"totals": _KEYED, "batches": f"{_KEYED}, batch long"}
#: Two versions of a counting rule: words, and letters, digits and signs apart.
VERSIONS = {"words-1": WORD, "parts-2": "[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^\\x20\\x09-\\x0D0-9A-Za-zÀ-ÖØ-öø-ÿ]"}


def _summed(rows: DataFrame) -> DataFrame:
    """rows by key; what is back at nothing is left out."""
    sums = rows.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS))
    return sums.where(" or ".join(f"{c} <> 0" for c in SUMS))


class Rollup:
    """Totals by source, language and tokenizer version in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.store = Snapshots(spark, folder, SCHEMAS, {"batches": ["batch"]})

    def commit(self, deltas: DataFrame, batch: int) -> None:
        """Make a batch count what its deltas say, once, however often it is committed."""
        columns_of(deltas, "source language tokenizer sign n_tokens")
        if batch <= int((self.store.latest()["info"] or {}).get("closed", -1)):
            return
        sign = F.coalesce(F.col("sign"), F.lit(1)).cast("long")
        told = deltas.select(*KEYS, sign.alias("n_docs"), (sign * F.coalesce("n_tokens", F.lit(0))).cast("long").alias("n_tokens"))
        before = self.store.read("batches").where(F.col("batch") == batch).select(*KEYS, *(-F.col(c) for c in SUMS)).toDF(*KEYS, *SUMS)
        change = reliable(_summed(told.unionByName(before)))
        totals = _summed(self.store.read("totals").unionByName(change))
        self.store.commit(append={"batches": change.withColumn("batch", F.lit(batch).cast("long"))}, replace={"totals": totals})

    def close(self, batch: int) -> None:
        """Forget the sums of all batches up to one; committed again, they change nothing."""
        self.store.commit(replace={"batches": self.store.read("batches").where(F.col("batch") > batch)}, info={"closed": str(batch)})

    def totals(self) -> DataFrame:
        """source, language, tokenizer, n_docs and n_tokens over all committed batches."""
        return self.store.read("totals")


def count(text: str | Column, version: str) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(VERSIONS[version])).cast("long")


def op6_token_rollup(spark, folder: str) -> DataFrame:
    """All documents inserted, revised to the second version, exact copies deleted; one batch comes twice."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    old, new = VERSIONS
    counted = docs.select("doc_id", "source", F.col("lang").alias("language"), F.sha2(text_or_empty("text").cast("binary"), 256).alias("digest"), count("text", old).alias("old"), count("text", new).alias("new"))
    counted = reliable(counted)
    first = reliable(counted.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n_rows")))
    delta = lambda rows, version, sign, n: rows.select("source", "language", F.lit(version).alias("tokenizer"), F.lit(sign).alias("sign"), F.col(n).alias("n_tokens"))
    inserts = delta(counted, old, 1, "old")
    revised = delta(counted, old, -1, "old").unionByName(delta(counted, new, 1, "new"))
    copies = delta(spread_join(counted, first, "digest", "n_rows").where("doc_id > first"), new, -1, "new")
    store = Rollup(spark, shared_folder(spark, "token-rollup"))
    for batch, deltas in ((1, inserts), (2, revised), (3, copies), (2, revised)):
        store.commit(deltas, batch)
    return store.totals()


OP6_SQL = f"""
with d as (select source, lang as language, len(regexp_extract_all(coalesce(text, ''), '{VERSIONS["parts-2"]}'))::bigint n,
  doc_id > min(doc_id) over (partition by coalesce(text, '')) dup from documents)
select source, language, 'parts-2' tokenizer, count(*)::bigint n_docs, sum(n)::bigint n_tokens from d where not coalesce(dup, false) group by source, language"""
