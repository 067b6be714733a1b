"""Near-duplicate documents by an LSH forest over MinHash signatures, with exact links.

Sets. A text's set is its distinct five-word shingles (A-Z lower-cased; fewer words: the whole
sequence as one shingle). Documents with equal sets form a class and are treated once.

Forest. A signature has HASHES minima. Tree t reads them in a rotated order; its classes are sorted
by that order over all of the cluster, in ranges of equal size, so no range grows with a crowd. A
region is what shares the first DEPTH entries of an order. In it the neighbours in the order are the
classes with the longest common prefix; how deep that goes differs from place to place, as far as
the region is crowded there.

Candidates. First, neighbours whose signatures agree in at least SIMILAR_ENOUGH of the entries. Their
links are confirmed on full sets and give components. Then, in every region that more than one
component reaches, all pairs of classes of different components are compared: those outside the
region's largest component with all of the region, block against block. Where signatures agree,
blocks are compared again with full sets, and links that join components are added. A pair that
shares several regions is compared in the first tree only. So no pair of a region is left out, no
bound is set on partners, and no task holds more than two blocks. Only the
comparison of crowds of similar classes that are no links grows with the square of the crowd.

Links. Every link is confirmed on full sets: 100 * common >= percent * union. Components of the
links are found by alternating stars, a few rounds of joins with a checkpoint each; links,
signatures and components never pass the driver.

A pair at similarity 0.75 shares a region of 3 entries in at least one of 24 trees with probability
1 - (1 - 0.75 ** 3) ** 24 > 0.999998, and passes the signature bound with probability > 0.9999.

Defined cases. Null and empty texts, and texts of spaces only: empty set, no link, their own
component. Null ids: never kept, and no component is named by one unless all its ids are null.
Repeated rows: same class, each row in the result. Extra columns do not matter. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventgraph.llm import words
from eventgraph.llm.common import arrow_map, columns_of, own, reliable, small_batches, spread_join, utf8_views

SHINGLE, PERCENT = 5, 75
HASHES, TREES, STEP = 128, 24, 5
#: Entries that name a region, and that an order is sorted by.
DEPTH, SORTED = 3, 16
#: Classes of a block, and shingles of it, about.
BLOCK, WEIGHT = 512, 2_000_000
SIMILAR_ENOUGH = 0.6
#: Rows of two numbers that may be broadcast (about 16 MB).
FEW = 400_000
_random = np.random.default_rng(75)
_TIMES = _random.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _random.integers(0, 2**32, HASHES, dtype=np.uint32)


def shingles(data: np.ndarray) -> np.ndarray:
    """The sorted distinct shingle hashes of a text given as UTF-8 bytes."""
    starts, ends = words.word_spans(data)
    if not len(starts):
        return np.zeros(0, np.uint64)
    hashes = words.span_hashes(words.lanes(data, lower=True), starts, ends)
    if len(hashes) < SHINGLE:
        return words.mixed(words.windows(hashes, len(hashes)) + np.uint64(len(hashes)))
    return np.unique(words.windows(hashes, SHINGLE))


def signature(found: np.ndarray) -> bytes:
    """HASHES minima of a set, 16 bits of each; the set is read in blocks that fit a cache."""
    low = found.astype(np.uint32)
    best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(low), 512):
        np.minimum(best, (low[None, start : start + 512] * _TIMES[:, None] + _PLUS[:, None]).min(1), out=best)
    return (best & np.uint32(0xFFFF)).astype("<u2").tobytes()


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, digest (of the set; null if empty), n_shingles and signature of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        digests, sizes, signatures = [], [], []
        for data in utf8_views(batch.column(2)):
            found = shingles(data)
            sizes.append(len(found))
            digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
            signatures.append(signature(found) if len(found) else None)
        columns = [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(signatures, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "digest", "n_shingles", "signature"])

    return arrow_map(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text"), work, f"doc_id {kind}, text_key long, digest binary, n_shingles long, signature binary")


def _fixed(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """A binary column of values of one size, as a matrix of numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _binary(rows: np.ndarray, there: np.ndarray | None = None) -> pa.Array:
    """Rows of bytes as a binary column, null where there is false."""
    values = [r.tobytes() for r in rows]
    return pa.array(values if there is None else [v if t else None for v, t in zip(values, there)], pa.binary())


def neighbours(classes: DataFrame) -> DataFrame:
    """(region, digest, next): a row for each class and region it shares, with its successor in the region's order.

    next is null at a region's end, and where the region goes on in another range.
    """
    order = F.expr(f"substring(concat(signature, signature), {2 * STEP} * tree + 1, {2 * SORTED})")
    trees = classes.select("digest", "signature", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    keyed = trees.select("tree", order.alias("order"), "digest")
    ranges = keyed.repartitionByRange("tree", "order", "digest").sortWithinPartitions("tree", "order", "digest")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, digest, joined = np.zeros(0, np.int64), np.zeros((0, 16), np.uint8), True  # the row that waits for its successor
        names = ["region", "digest", "next"]
        for batch in batches:
            if not batch.num_rows:
                continue
            entries = _fixed(batch.column(1), ">u2", SORTED)[:, :DEPTH].astype(np.int64)
            key = batch.column(0).to_numpy().astype(np.int64)
            for k in range(DEPTH):
                key = key << 16 | entries[:, k]
            region, digest = np.concatenate([region, key]), np.concatenate([digest, _fixed(batch.column(2), "u1", 16)])
            same = region[1:] == region[:-1]
            shared = np.flatnonzero(same | np.r_[joined, same[:-1]]) if len(same) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(region[shared]), _binary(digest[shared]), _binary(digest[shared + 1], same[shared])], names)
            joined = bool(same[-1]) if len(same) else True
            region, digest = region[-1:], digest[-1:]
        if len(region):  # its successor may stand in the next range
            yield pa.RecordBatch.from_arrays([pa.array(region), _binary(digest), pa.array([None], pa.binary())], names)

    return small_batches(ranges).mapInArrow(work, "region long, digest binary, next binary")


def agreeing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures agree enough."""
    signatures = classes.select("digest", "signature")
    both = pairs.join(signatures.toDF("a", "_a"), "a").join(signatures.toDF("b", "_b"), "b")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        one, other = (_fixed(batch.column(k), "<u2", HASHES) for k in (2, 3))
        good = pa.array((one == other).sum(1) >= SIMILAR_ENOUGH * HASHES)
        return pa.RecordBatch.from_arrays([batch.column(k).filter(good) for k in (0, 1)], ["a", "b"])

    return arrow_map(both.select("a", "b", "_a", "_b"), work, "a binary, b binary")


def blocks(shared: DataFrame, info: DataFrame) -> DataFrame:
    """(block, tree, digest, root, side): what is still to be compared, dealt into blocks.

    side is 1 for a class that asks, which is outside its region's largest component (main), and for
    a class that is asked 0, or 2 if it asks as well. Every asking class meets every class of its region
    in one block. Regions of two whose pair is among the neighbours are done.
    """
    named = reliable(shared.join(info.select("digest", "root", "n_shingles"), "digest").select("region", "digest", "root", "n_shingles", F.col("next").isNotNull().cast("int").alias("pair")))
    sums = [F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("w"), F.sum("pair").alias("pairs")]
    roots = named.groupBy("region", "root").agg(*sums)
    largest = F.max(F.struct("n", "root", "w"))
    regions = roots.groupBy("region").agg(largest.alias("main"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum("pairs").alias("pairs"), F.count(F.lit(1)).alias("roots"))
    regions = regions.where("roots > 1 and not (n = 2 and pairs = 1)")
    many = lambda n, w: F.greatest(F.ceil(n / BLOCK), F.ceil(w / WEIGHT), F.lit(1)).cast("int")
    regions = regions.select("region", F.col("main.root").alias("main"), many(F.col("n"), F.col("w")).alias("asked"), many(F.col("n") - F.col("main.n"), F.col("w") - F.col("main.w")).alias("asking"))
    placed = named.join(regions, "region").withColumn("asks", F.col("root") != F.col("main"))
    own = lambda n: F.pmod(F.xxhash64("digest"), F.col(n)).cast("int")
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    at = lambda asked, asking, side: F.struct(asked.alias("asked"), asking.alias("asking"), side.cast("int").alias("side"))
    is_asked = F.transform(each("asking"), lambda k: at(own("asked"), k, F.when(F.col("asks"), 2).otherwise(0)))
    does_ask = F.when(F.col("asks"), F.transform(each("asked"), lambda k: at(k, own("asking"), F.lit(1))))
    rows = placed.select("region", "digest", "root", F.explode(F.concat(is_asked, F.coalesce(does_ask, F.array().cast("array<struct<asked:int,asking:int,side:int>>")))).alias("at"))
    return rows.select(F.xxhash64("region", "at.asked", "at.asking").alias("block"), F.shiftright("region", 16 * DEPTH).cast("int").alias("tree"), "digest", "root", F.col("at.side").alias("side"))


def _by_block(rows: DataFrame, work_on, schema: str) -> DataFrame:
    """What work_on gives for whole blocks; the rows of a block and side stand together."""
    dealt = rows.repartition("block").sortWithinPartitions("block", "tree", "side", "digest")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            block = table["block"].to_numpy()
            begun = int(np.searchsorted(block, block[-1]))  # the last block may go on
            if begun:
                yield work_on(table.slice(0, begun).combine_chunks())
            rest = table.slice(begun)
        if rest is not None and rest.num_rows:
            yield work_on(rest.combine_chunks())

    return small_batches(dealt).mapInArrow(work, schema)


def _near(table: pa.Table, percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, rows, roots by row) for each asking row of whole blocks that has partners.

    Partners agree enough in signature and size, are of other roots, and meet first in this tree. The
    caller may merge roots on the way.
    """
    block, tree, side, sizes = (table[c].to_numpy() for c in ("block", "tree", "side", "n_shingles"))
    entries = _fixed(table["signature"].combine_chunks(), "<u2", HASHES)
    root = np.unique(np.array(table["root"].to_pylist(), "S16"), return_inverse=True)[1]
    digest = np.array(table["digest"].to_pylist(), "S16")
    columns = (STEP * np.arange(TREES)[:, None] + np.arange(DEPTH)) % HASHES
    starts = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (tree[1:] != tree[:-1])])
    for start, end in zip(starts, np.r_[starts[1:], len(block)]):
        own = np.arange(start, end)
        who, there = own[side[own] == 1], own[side[own] != 1]
        if not len(who) or not len(there):
            continue
        across = np.ascontiguousarray(entries[there].T)
        before = columns[: tree[start]]
        for i in who:
            open_ = root[there] != root[i]
            if not open_.any():
                continue
            least, most = np.minimum(sizes[there], sizes[i]), np.maximum(sizes[there], sizes[i])
            common = (across == entries[i][:, None]).sum(0)
            near = open_ & (common >= SIMILAR_ENOUGH * HASHES) & (100 * least >= percent * most) & ~((side[there] == 2) & (digest[there] <= digest[i]))
            near = there[near][np.argsort(-common[near], kind="stable")]
            if len(near) and len(before):
                near = near[~(entries[near][:, before] == entries[i][before]).all(2).any(1)]
            if len(near):
                yield i, near, root


def asking_rows(rows: DataFrame, percent: int) -> DataFrame:
    """Of blocks with signatures: the rows (as in blocks) that have a partner."""

    def work(table: pa.Table) -> pa.RecordBatch:
        has = np.zeros(table.num_rows, bool)
        for i, near, _ in _near(table, percent):
            has[i] = True
            has[near] = True
        kept = table.select(["block", "tree", "digest", "root", "side"]).filter(pa.array(has)).combine_chunks()
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in kept.columns], kept.schema.names)

    return _by_block(rows, work, "block long, tree int, digest binary, root binary, side int")


def joining_links(rows: DataFrame, percent: int) -> DataFrame:
    """Of blocks with signatures and full sets: the pairs (a, b) of roots that links join."""

    def work(table: pa.Table) -> pa.RecordBatch:
        members = pa.concat_arrays(table["members"].chunks)
        bounds, values = members.offsets.to_numpy(), members.values.to_numpy()
        own_set = lambda i: values[bounds[i] : bounds[i + 1]]
        found: set[tuple[int, int]] = set()
        for i, near, root in _near(table, percent):
            mine = own_set(i)
            for j in near:
                if root[i] == root[j]:
                    continue
                other = own_set(j)
                both = len(np.intersect1d(mine, other, assume_unique=True))
                if 100 * both >= percent * (len(mine) + len(other) - both):
                    found.add((int(i), int(j)))
                    root[root == root[j]] = root[i]
        names = table["root"].to_pylist()
        return pa.RecordBatch.from_arrays([pa.array([names[p[k]] for p in found], pa.binary()) for k in (0, 1)], ["a", "b"])

    return _by_block(rows, work, "a binary, b binary").distinct()


def rest(docs: DataFrame, shared: DataFrame, info: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) of roots that links join which are not among the neighbours."""
    signed_ = classes.select("digest", "n_shingles", "signature")
    asking = reliable(asking_rows(blocks(shared, info).join(signed_, "digest"), percent))
    known = classes.join(asking.select("digest").distinct(), "digest", "left_semi")
    known = known.select("digest", "n_shingles", "signature").join(sets(docs, known.select("rep")).dropDuplicates(["digest"]), "digest")
    return joining_links(asking.join(known, "digest"), percent)


def sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(digest, members): full sets of the wanted classes, each from one document that has it."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    wanted = small_or_not(reliable(wanted.select(F.col("rep.doc_id").alias("_id"), F.col("rep.text_key").alias("_key"))))
    rows = rows.join(wanted, F.expr("doc_id <=> _id and text_key = _key"), "left_semi").select("text")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingles(d) for d in utf8_views(batch.column(0))]
        keep = [s for s in found if len(s)]
        digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in keep]
        offsets = np.cumsum([0, *map(len, keep)]).astype(np.int32)
        values = np.concatenate(keep).view(np.int64) if keep else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["digest", "members"])

    return arrow_map(rows, work, "digest binary, members array<long>")


def full_sets(docs: DataFrame, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(digest, members) of all classes that are in a pair."""
    involved = pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct().join(classes, "digest").select("rep")
    return sets(docs, involved).dropDuplicates(["digest"])


def small_or_not(rows: DataFrame) -> DataFrame:
    """Materialised rows, marked for a broadcast only if they are counted to be few; else they are shuffled."""
    return F.broadcast(rows) if rows.count() <= FEW else rows


def links(pairs: DataFrame, members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = pairs.join(members.select(F.col("digest").alias("a"), F.col("members").alias("_a")), "a")
    both = left.join(members.select(F.col("digest").alias("b"), F.col("members").alias("_b")), "b")
    common = F.size(F.array_intersect("_a", "_b"))
    return both.where(100 * common >= percent * (F.size("_a") + F.size("_b") - common)).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for each node of the edges (a, b) the least node that it is connected with.

    Alternating large and small stars; each round is checkpointed, and the rounds end when the
    edges, told by their number and a sum of hashes, stay the same.
    """
    now = reliable(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = reliable(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        now = reliable(small.where("u <> v").distinct())
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id and kept of each row of docs (doc_id, text)."""
    columns_of(docs, "doc_id text")
    rows = reliable(signed(docs))
    some = rows.where("digest is not null")
    aggregates = [F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "text_key")).alias("rep"), F.max("signature").alias("signature"), F.max("n_shingles").alias("n_shingles")]
    classes = reliable(some.groupBy("digest").agg(*aggregates))
    shared = reliable(neighbours(classes))
    pairs = shared.where("next is not null").select(F.least("digest", "next").alias("a"), F.greatest("digest", "next").alias("b")).distinct()
    pairs = reliable(agreeing(pairs, classes))
    rooted = components(links(pairs, full_sets(docs, pairs, classes), percent))
    info = classes.select("digest", "least", "copies", "n_shingles").join(rooted.withColumnRenamed("node", "digest"), "digest", "left")
    info = reliable(info.withColumn("root", F.coalesce("root", "digest")))
    joined = components(rest(docs, shared, info, classes, percent)).select(F.col("node").alias("root"), F.col("root").alias("last"))
    info = reliable(info.join(joined, "root", "left").select("digest", "least", "copies", F.coalesce("last", "root").alias("root")))
    of_root = reliable(info.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")))
    named = reliable(spread_join(info, of_root, "root", "n").select("digest", "copies", "component_id"))
    linked = spread_join(some, named, "digest", "copies").select("doc_id", "text_key", "n_shingles", "component_id")
    alone = rows.where("digest is null").select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def deduplicate(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each group: the one whose id names the group.

    Rows that agree in id and text are one document. Rows without id stay if no row of their group
    has one. Texts are shuffled only where such repeated rows are, or where more rows go than may be
    broadcast.
    """
    key, order = own(docs, "_text_key"), own(docs, "_row")
    rows = reliable(near_duplicates(docs, percent).groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"), F.min("component_id").alias("component_id")))
    ids = [F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")]
    goes = ~F.col("doc_id").eqNullSafe(F.col("component_id"))
    gone = small_or_not(reliable(rows.where(goes).select(*ids)))
    twice = reliable(rows.where(~goes & (F.col("n") > 1)).select(*ids))
    same = F.expr(f"doc_id <=> _id and `{key}` = _key")
    stays = docs.withColumn(key, F.xxhash64("text")).join(gone, same, "left_anti")
    if twice.isEmpty():
        return stays.select(*[F.col(f"`{c}`") for c in docs.columns])
    twice = small_or_not(twice)
    one = stays.join(twice, same, "left_semi").withColumn(order, F.row_number().over(W.partitionBy("doc_id", key).orderBy(key))).where(F.col(order) == 1).drop(order)
    return stays.join(twice, same, "left_anti").unionByName(one).select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_near_duplicates(spark, folder: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{folder}/documents.parquet")).drop("text_key")
