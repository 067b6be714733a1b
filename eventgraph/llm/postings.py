"""Phrases and proximity of benchmark items in training text, by a distributed positional inverted index.

Index. Documents are indexed in blocks of whole texts (at most ROWS texts and BYTES bytes, or one text). A
block's row holds the ids of its documents, where each begins (word numbers run through a block), its
distinct terms, and for every term its postings: all its word numbers, in order, as differences in variable-length
bytes. Every word of every text is indexed. Blocks are built and written where their texts are read,
without a shuffle, so no term, however common, is held by one task.

Search. A pass takes test items of at most PASS_BYTES bytes, so what is sent to the tasks has a bound; more
items mean more passes over the index. The terms' total frequencies are summed over all blocks first, from
the columns of terms and counts alone. In each block a phrase starts from its rarest term: its postings less the
term's place in the phrase are where the phrase may begin; they are intersected with the next rarest term's
list, moved likewise, until none is left or all terms agree. Only the lists of phrases all of whose terms
the block has are unpacked. Terms are compared as text, so a match is exact. A proximity match starts
from the rarest term too and looks for all of an item's terms within a reach around it.

A word is a maximal stretch of digits, letters and bytes above 127, A-Z lower-cased.

Defined cases. Null and empty texts: no words, nothing hit. An item without words: occurs nowhere; one
shorter than a window: one window. Null doc_id: a row like others. Null item_id: the empty string. Items with the same
id: one item. Repeated rows: each its result. Very long texts: whole. Empty tables: no documents, no rows; no
items, nothing hit. Extra columns do not matter.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventgraph.llm.common import columns_of, shared_folder, sliced, small_batches, utf8_views

WINDOW = 10
#: Texts and bytes of a block, bytes of the items of a pass, words of a piece of an item.
ROWS, BYTES, PASS_BYTES, PIECE = 2048, 8 << 20, 4 << 20, 4096
#: Bytes as words have them: A-Z lower-cased, what is no part of a word a space.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))
INDEX = "block long, docs array<{kind}>, begins array<int>, terms binary, counts binary, ends binary, postings binary"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLDED).split()


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in variable-length bytes, seven bits each, lowest first, and the end of each."""
    values = values.astype(np.uint64)
    n_bytes = np.ones(len(values), np.int64)
    for k in range(1, 5):
        n_bytes += values >= np.uint64(1 << 7 * k)
    ends = np.cumsum(n_bytes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(5):
        has = np.flatnonzero(n_bytes > k)
        if not len(has):
            break
        more = np.where(n_bytes[has] > k + 1, 128, 0)
        out[ends[has] - n_bytes[has] + k] = ((values[has] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.int64) | more
    return out, ends


def unpacked(data: np.ndarray) -> np.ndarray:
    """The numbers that packed made from their differences."""
    last = np.flatnonzero(data < 128)
    first = np.r_[0, last[:-1] + 1] if len(last) else last
    values = np.zeros(len(last), np.int64)
    for k in range(int((last - first).max(initial=0)) + 1):
        at = first + k
        has = at <= last
        values[has] |= (data[at[has]].astype(np.int64) & 127) << (7 * k)
    return np.cumsum(values)


def block_of(texts: Iterator[bytes]) -> tuple[list[int], bytes, bytes, bytes, bytes]:
    """begins (and the end), terms, counts, ends and postings of a block of texts."""
    number: dict[bytes, int] = {}
    begins, ids = [0], []
    for text in texts:
        ids += [number.setdefault(w, len(number)) for w in words_of(text)]
        begins.append(len(ids))
    keys = (np.array(ids, np.uint64) << np.uint64(32)) | np.arange(len(ids), dtype=np.uint64)
    keys.sort()
    terms, at = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
    counts = np.bincount(terms, minlength=len(number))
    steps = np.diff(at, prepend=0)
    firsts = np.cumsum(counts) - counts
    steps[firsts] = at[firsts]
    out, ends = packed(steps)
    upto = ends[np.cumsum(counts) - 1] if len(counts) else ends
    return begins, b" ".join(number), counts.astype("<u4").tobytes(), upto.astype("<u4").tobytes(), out.tobytes()


def build(docs: DataFrame, folder: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of all texts, written to a folder that all executors share, and read from there."""
    columns_of(docs, f"{key} {text}")
    spark = docs.sparkSession
    schema = INDEX.format(kind=docs.schema[key].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in sliced(batch, ROWS, BYTES):
                begins, *rest = block_of(v.tobytes() for v in utf8_views(part.column(1)))
                columns = [pa.array([block], pa.int64()), pa.array([part.column(0).to_pylist()], pa.list_(part.column(0).type)), pa.array([begins], pa.list_(pa.int32())), *(pa.array([x], pa.binary()) for x in rest)]
                block += 1
                yield pa.RecordBatch.from_arrays(columns, ["block", "docs", "begins", "terms", "counts", "ends", "postings"])

    folder = folder or shared_folder(spark, "postings")
    small_batches(docs.select(key, text)).mapInArrow(run, schema).write.parquet(folder)
    return spark.read.schema(schema).parquet(folder)


@dataclass
class Phrases:
    """Distinct phrases of one pass as numbers of terms, and the items that each belongs to."""

    terms: list[bytes]
    rows: list[tuple[int, ...]]
    owners: list[list[str]]

    def rarest_first(self, frequency: dict[bytes, int]) -> list[list[int]]:
        """Of each phrase, its places in order of the terms' total frequency; no place if one term occurs nowhere."""
        often = [frequency.get(t, 0) for t in self.terms]
        return [sorted(range(len(r)), key=lambda k: (often[r[k]], k)) if all(often[t] for t in r) else [] for r in self.rows]


def pieces(items: DataFrame, width: int) -> DataFrame:
    """(item_id, words): the items' words in stretches that overlap by a window less one word."""
    columns_of(items, "item_id text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for item, data in zip(batch.column(0).to_pylist(), utf8_views(batch.column(1))):
                words = words_of(data.tobytes())
                for at in range(0, max(len(words) - width, 0) + 1, PIECE):
                    ids.append(item)
                    found.append(b" ".join(words[at : at + PIECE + width - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(found, pa.binary())], ["item_id", "words"])

    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    return rows.mapInArrow(run, "item_id string, words binary").where("length(words) > 0")


def phrases_of(rows, width: int) -> Phrases:
    """All windows of the collected pieces of a pass."""
    number: dict[bytes, int] = {}
    owners: dict[tuple[int, ...], set[str]] = {}
    for item, words in rows:
        ids = [number.setdefault(w, len(number)) for w in bytes(words).split()]
        for at in range(max(len(ids) - width, 0) + 1):
            owners.setdefault(tuple(ids[at : at + width]), set()).add(item)
    return Phrases(list(number), list(owners), [sorted(x) for x in owners.values()])


class Block:
    """One block of the index as a search reads it: the lists of wanted terms are unpacked when they are first asked for."""

    def __init__(self, terms: bytes, ends: bytes, postings: bytes, begins: np.ndarray, wanted: dict[bytes, int]):
        self.where = {wanted[t]: i for i, t in enumerate(terms.split()) if t in wanted}
        self.ends, self.data, self.begins = np.frombuffer(ends, "<u4"), np.frombuffer(postings, np.uint8), begins
        self.lists: dict[int, np.ndarray] = {}

    def places(self, term: int) -> np.ndarray:
        if term not in self.lists:
            i = self.where[term]
            self.lists[term] = unpacked(self.data[int(self.ends[i - 1]) if i else 0 : int(self.ends[i])])
        return self.lists[term]

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, at, "right") - 1

    def phrase(self, row: tuple[int, ...], order: list[int]) -> np.ndarray:
        """Where a phrase begins."""
        if not order or not all(t in self.where for t in row):
            return np.zeros(0, np.int64)
        at = self.places(row[order[0]]) - order[0]
        for k in order[1:]:
            there = self.places(row[k]) - k
            spot = np.searchsorted(there, at)
            at = at[(spot < len(there)) & (there[np.minimum(spot, len(there) - 1)] == at)]
            if not len(at):
                return at
        at = at[at >= 0]
        return at[self.doc_of(at) == self.doc_of(at + len(row) - 1)]

    def near(self, terms: list[int], rarest: int, reach: int) -> dict[int, int]:
        """Of each document that has all terms within reach words, the fewest words that hold them."""
        found: dict[int, int] = {}
        if not all(t in self.where for t in terms):
            return found
        lists = {t: self.places(t).tolist() for t in terms}
        for p in lists[rarest]:
            doc = int(self.doc_of(np.array([p]))[0])
            low, high = max(p - reach + 1, int(self.begins[doc])), min(p + reach, int(self.begins[doc + 1]))
            around = sorted((q, t) for t in terms for q in lists[t][bisect_left(lists[t], low) : bisect_left(lists[t], high)])
            held, first = dict.fromkeys(terms, 0), 0
            missing = len(terms)
            for q, t in around:
                missing -= not held[t]
                held[t] += 1
                while not missing:
                    start, other = around[first]
                    if q - start < reach:
                        found[doc] = min(found.get(doc, reach), q - start + 1)
                    held[other] -= 1
                    missing += not held[other]
                    first += 1
        return found


def frequencies(index: DataFrame, terms: list[bytes]) -> dict[bytes, int]:
    """How often each of the given terms occurs in all texts; terms are those of one pass."""
    wanted = set(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[bytes, int] = {}
        for batch in batches:
            for own, counts in zip(batch.column(0), batch.column(1)):
                n = np.frombuffer(counts.as_buffer(), "<u4")
                for i, t in enumerate(own.as_py().split()):
                    if t in wanted:
                        sums[t] = sums.get(t, 0) + int(n[i])
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.binary()), pa.array(list(sums.values()), pa.int64())], ["term", "n"])

    return {bytes(r.term): r.n for r in index.select("terms", "counts").mapInArrow(run, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}


def passes(items: DataFrame, width: int) -> list[DataFrame]:
    """The pieces of all items, dealt into passes of about PASS_BYTES."""
    size = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(1, -(-size // PASS_BYTES))
    all_pieces = pieces(items, width)
    return [all_pieces.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(n)) == k) for k in range(n)]


FOUND = "block long, doc int, doc_id {kind}, n_words long, spans array<struct<start:bigint,end:bigint>>, items array<string>"


def phrase_pass(index: DataFrame, wanted: Phrases) -> DataFrame:
    """One row a document: the stretches of its words that phrases cover, and the items that they belong to."""
    order = wanted.rarest_first(frequencies(index, wanted.terms))
    alive = [i for i, o in enumerate(order) if o]
    terms = {t: i for i, t in enumerate(wanted.terms)}
    kind = index.schema["docs"].dataType.elementType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                number, docs, begins, own, ends, postings = (batch.column(i)[r] for i in range(6))
                begins = begins.values.to_numpy()
                block = Block(own.as_py(), ends.as_buffer(), postings.as_buffer(), begins, terms)
                n_docs = len(begins) - 1
                edges, items = np.zeros(int(begins[-1]) + 1, np.int64), {}
                for i in alive:
                    row = wanted.rows[i]
                    at = block.phrase(row, order[i])
                    if len(at):
                        edges[at] += 1
                        edges[at + len(row)] -= 1
                        for d in set(block.doc_of(at).tolist()):
                            items.setdefault(d, set()).update(wanted.owners[i])
                spans = [[] for _ in range(n_docs)]
                if items:
                    covered, fresh = np.cumsum(edges[:-1]) > 0, np.zeros(len(edges), bool)
                    fresh[begins] = True  # a stretch ends with its document
                    starts = np.flatnonzero(covered & (np.diff(covered, prepend=False) | fresh[:-1]))
                    stops = np.flatnonzero(covered & (np.diff(covered, append=False) | fresh[1:])) + 1
                    for a, b, d in zip(starts.tolist(), stops.tolist(), block.doc_of(starts).tolist()):
                        spans[d].append({"start": a - int(begins[d]), "end": b - int(begins[d])})
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number.as_py()] * n_docs, pa.int64()), pa.array(range(n_docs), pa.int32()), docs.values, pa.array(np.diff(begins), pa.int64()), pa.array(spans, span), pa.array([sorted(items.get(d, ())) for d in range(n_docs)], pa.list_(pa.string()))],
                    ["block", "doc", "doc_id", "n_words", "spans", "items"],
                )

    return index.select("block", "docs", "begins", "terms", "ends", "postings").mapInArrow(found, FOUND.format(kind=kind))


def phrases(index: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """One row a document: doc_id, n_words, spans (from and to a word number) that windows of items cover, n_hit, items.

    A window is width consecutive words of an item, or all words of a shorter one.
    """
    small_batches(index)
    done = [phrase_pass(index, phrases_of(p.collect(), width)) for p in passes(items, width)]  # a pass has a bound
    rows = done[0]
    if len(done) > 1:
        for more in done[1:]:
            rows = rows.unionByName(more.where("size(items) > 0"))
        listed = lambda c: F.flatten(F.collect_list(c)).alias(c)
        rows = rows.groupBy("block", "doc", "doc_id", "n_words").agg(listed("spans"), listed("items"))
        rows = rows.withColumn("spans", F.array_sort("spans")).withColumn("items", F.array_sort(F.array_distinct("items")))
    first = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n"))
    step = lambda s, x: F.struct(F.greatest(s["upto"], x["end"]).alias("upto"), (s["n"] + F.greatest(x["end"] - F.greatest(s["upto"], x["start"]), F.lit(0))).alias("n"))
    return rows.select("doc_id", "n_words", "spans", F.aggregate("spans", first, step)["n"].alias("n_hit"), "items")


def near(index: DataFrame, items: DataFrame, reach: int) -> DataFrame:
    """(doc_id, item_id, n_words): documents with all distinct words of an item within reach words, and the fewest that hold them.

    An item is taken whole; items without words match nothing.
    """
    small_batches(index)
    kind = index.schema["docs"].dataType.elementType.simpleString()
    done = None
    size = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(1, -(-size // PASS_BYTES))
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    for k in range(n):
        sets = {(item, frozenset(words_of(bytes(text)))) for item, text in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()}
        terms = {t: i for i, t in enumerate(sorted({t for _, s in sets for t in s}))}
        often = frequencies(index, list(terms))
        wanted = [(item, sorted(terms[t] for t in s), terms[min(s, key=lambda t: (often[t], t))]) for item, s in sets if s and all(t in often for t in s)]

        def found(batches: Iterator[pa.RecordBatch], wanted=wanted, terms=terms) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in range(batch.num_rows):
                    docs, begins, own, ends, postings = (batch.column(i)[r] for i in range(5))
                    block = Block(own.as_py(), ends.as_buffer(), postings.as_buffer(), begins.values.to_numpy(), terms)
                    hits = [(d, item, w) for item, own_terms, rarest in wanted for d, w in block.near(own_terms, rarest, reach).items()]
                    yield pa.RecordBatch.from_arrays([docs.values.take(pa.array([h[0] for h in hits], pa.int64())), pa.array([h[1] for h in hits], pa.string()), pa.array([h[2] for h in hits], pa.int64())], ["doc_id", "item_id", "n_words"])

        part = index.select("docs", "begins", "terms", "ends", "postings").mapInArrow(found, f"doc_id {kind}, item_id string, n_words long")
        done = done.unionByName(part) if done is not None else part
    return done


def op11_decontamination(spark, folder: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    found = phrases(build(docs), items)
    listed = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _sql() -> str:
    word = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    words = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{word}')"
    return f"""
with d as (select row_number() over () rid, doc_id, {words} ws from documents),
b as (select coalesce(item_id::varchar, '') item_id, {words} ws from benchmark),
w as (select distinct item_id, least(len(ws), {WINDOW}) width, array_to_string(ws[i + 1:i + least(len(ws), {WINDOW})], ' ') phrase
  from (select item_id, ws, unnest(range(greatest(len(ws) - {WINDOW}, 0) + 1)) i from b where len(ws) > 0)),
p as (select rid, i, width, array_to_string(ws[i + 1:i + width], ' ') phrase from (select rid, ws, width, unnest(range(greatest(len(ws) - width + 1, 0))) i from d, (select distinct width from w))),
m as (select rid, i, width, item_id from p join w using (width, phrase)),
h as (select rid, count(distinct place) n_hit from (select rid, unnest(range(i, i + width)) place from (select distinct rid, i, width from m)) group by rid),
t as (select rid, count(distinct item_id) n_items, string_agg(distinct item_id, ',' order by item_id) items from m group by rid)
select doc_id, len(ws)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join h using (rid) left join t using (rid)"""


OP11_SQL = _sql()
