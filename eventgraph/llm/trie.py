"""Prefix trie of conversations, built by van Emde Boas recursion.

Node. Each distinct sequence of the first d turns of some conversation is a node of depth d; it is named by
the smallest conv_id that begins with it, so that (depth, name) tells nodes apart and a name's own
path leads through them.

Down. The range of depths is cut in half, the halves again, and so on; all ranges of one size are
worked on together. At a cut every conversation that is long enough gets the name of its prefix up
to there: the group of what the range's top is named and of the digest of the turns between. The
digests come from the bottom, each of the two of half its length. Above the cut lies the upper trie,
below each name a tree of the lower forest, and both are cut further without regard to one another. A
conversation that is alone at a cut is alone below and is grouped no more.

Up. Each node begins with its own totals. Two neighbouring ranges become one as the totals of each
tree of the lower forest are grafted on all nodes of the upper trie on the path to its root. These
are read off the path of the conversation that names the root, so that the pairs of one round are never more
than the turns. There are as many rounds each way as halvings of the longest conversation.

A common prefix is a common key: groups are counted before they are shuffled, and rows of common
groups meet the groups' names by a broadcast of fewer than a thousand rows (``spread_join``). Ids that end at a node are sorted by
ranges, joined in pieces there, and hashed in a stream, so a node where a third of all conversations
end holds no task's memory. Turns are numbered over the whole cluster, not by conversation.

Defined cases. Null turn: first. Null role or text: empty. Equal turn numbers: in order of role and
text. Repeated rows: turns of their own. Rows without a conv_id belong to no conversation and make no node. Very long texts: whole.
Conversations without turns: members of the root. Empty table: no rows. Extra columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventgraph.llm.common import CRC32_TABLE_SQL, columns_of, crc32_sql, reliable, small_batches, spread_join
from eventgraph.operators.ordering import numbered

#: Conversations of one hundred share up to this many first turns in the query.
SHARED, HUNDRED = 6, 100


def numbered_turns(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, n, item, weight, n_turns) of each turn and (conv_id, n_turns) of each conversation.

    n counts from 1; an item is a digest of role and text, its weight the text's code points.
    """
    columns_of(rows, "conv_id turn role text")
    clean = rows.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    item = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    placed = numbered(clean, "conv_id", "turn", "role", "text", into="place").select("conv_id", "place", item.alias("item"), F.length("text").cast("long").alias("weight"))
    convs = reliable(placed.groupBy("conv_id").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n_turns")))
    return spread_join(placed, convs, "conv_id", "n_turns").select("conv_id", (F.col("place") - F.col("first") + 1).alias("n"), "item", "weight", "n_turns"), convs.select("conv_id", "n_turns")


def paths_of(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Paths (conv_id, depth, item, weight, ends) of conversations as they are; depth 0 has no item."""
    top = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("string").alias("item"), F.lit(0).cast("long").alias("weight"), (F.col("n_turns") == 0).alias("ends"))
    return turns.select("conv_id", F.col("n").alias("depth"), "item", "weight", (F.col("n") == F.col("n_turns")).alias("ends")).unionByName(top)


def rebuilt(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Paths of conversations whose first turns are those of the first of their hundred; how many, a hash of the id says."""
    turns = reliable(turns)
    giver = F.col("conv_id") - F.col("conv_id") % HUNDRED
    gives = F.col("conv_id") % HUNDRED == 0
    has = convs.where(gives).select(F.col("conv_id").alias("giver"), F.col("n_turns").alias("given"))
    wants = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    plan = convs.withColumn("giver", giver).withColumn("skip", wants).join(has, "giver", "left")
    plan = plan.select("conv_id", "giver", "n_turns", "skip", F.least("skip", F.coalesce("given", F.lit(0))).alias("taken"))
    plan = reliable(plan.withColumn("size", F.greatest(F.col("n_turns") - F.col("skip"), F.lit(0)) + F.col("taken")))
    own = spread_join(turns.drop("n_turns"), plan, "conv_id", "n_turns").where("n > skip").select("conv_id", (F.col("n") - F.col("skip") + F.col("taken")).alias("n"), "item", "weight", F.col("size").alias("n_turns"))
    first = turns.where(gives & (F.col("n") < SHARED)).select(F.col("conv_id").alias("giver"), "n", "item", "weight")
    lent = plan.join(first, "giver").where("n <= taken").select("conv_id", "n", "item", "weight", F.col("size").alias("n_turns"))
    return paths_of(own.unionByName(lent), plan.select("conv_id", F.col("size").alias("n_turns")))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of equal nodes within a batch, sorted, as comma-joined pieces."""
    for batch in batches:
        depth, name, ids = (batch.column(i) for i in range(3))
        n = batch.num_rows
        if not n:
            continue
        changes = pc.or_(pc.not_equal(depth.slice(1), depth.slice(0, n - 1)), pc.not_equal(name.slice(1), name.slice(0, n - 1)))
        starts = [0, *(i + 1 for i, c in enumerate(changes.to_pylist()) if c), n]
        texts = ids.cast(pa.string()).to_pylist()
        at = pa.array(starts[:-1], pa.int64())
        pieces = [",".join(texts[a:b]) for a, b in zip(starts, starts[1:])]
        yield pa.RecordBatch.from_arrays([depth.take(at), name.take(at), ids.take(at), pa.array(pieces, pa.string())], ["depth", "name", "first", "piece"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of all pieces of a node, which come one after the other."""
    node, state = None, hashlib.sha256()

    def told(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[0][0] for d in done], pa.int64()), pa.array([d[0][1] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], ["depth", "name", "ends_sha256"])

    for batch in batches:
        done = []
        for depth, name, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
            if (depth, name) != node:
                if node:
                    done.append((node, state.hexdigest()))
                node, state = (depth, name), hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
        yield told(done)
    if node:
        yield told([(node, state.hexdigest())])


def ends(rows: DataFrame) -> DataFrame:
    """ends_sha256 of each node (depth, name) with conv_ids, ascending and comma-joined."""
    order = ["depth", "name", "conv_id"]
    ranged = small_batches(rows.select(*order)).repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = ranged.mapInArrow(_joined, "depth long, name long, first long, piece string")
    return pieces.repartition("depth", "name").sortWithinPartitions("depth", "name", "first").mapInArrow(_hashed, "depth long, name long, ends_sha256 string")


def named(paths: DataFrame, size: int) -> DataFrame:
    """(conv_id, depth, name, n_convs) of every prefix of every path; size is a power of two above all depths."""
    parts = {1: paths.where("depth > 0").select("conv_id", (F.col("depth") - 1).alias("j"), "item")}
    s = 1
    while 2 * s < size:
        half = lambda k: F.max(F.when(F.col("j") % 2 == k, F.col("item")))
        both = parts[s].groupBy("conv_id", F.floor(F.col("j") / 2).alias("j2")).agg(half(0).alias("a"), half(1).alias("b")).where("b is not null")
        s *= 2
        parts[s] = reliable(both.select("conv_id", F.col("j2").alias("j"), F.sha2(F.concat("a", "b").cast("binary"), 256).alias("item")))
    root = paths.where("depth = 0").agg(F.min("conv_id").alias("name"), F.count(F.lit(1)).alias("n_convs"))
    names = reliable(paths.where("depth = 0").select("conv_id", "depth").join(F.broadcast(root)))  # one row
    while s:
        cuts = parts[s].where("j % 2 = 0").select("conv_id", (F.col("j") * s).alias("depth"), "item")
        below = cuts.join(names, ["conv_id", "depth"]).withColumn("depth", F.col("depth") + s)
        alone = below.where("n_convs = 1").select("conv_id", "depth", "name", "n_convs")
        shared = below.where("n_convs > 1").select("conv_id", "depth", F.concat_ws(",", "depth", "name", "item").alias("key"))
        shared = reliable(shared)
        groups = reliable(shared.groupBy("key").agg(F.min("conv_id").alias("name"), F.count(F.lit(1)).alias("n_convs")))
        found = spread_join(shared, groups, "key", "n_convs").select("conv_id", "depth", "name", "n_convs")
        names = reliable(names.unionByName(alone).unionByName(found))
        s //= 2
    return names


def grafted(totals: DataFrame, names: DataFrame, size: int, summed: tuple[str, ...]) -> DataFrame:
    """Totals of nodes (depth, name) as sums over their subtrees."""
    totals, s = totals.select("depth", "name", *summed), 1
    while s < size:
        block = F.floor(F.col("depth") / (2 * s))
        roots = totals.where(F.col("depth") % (2 * s) == s).select(F.col("name").alias("conv_id"), block.alias("block"), *summed)
        upper = names.where((F.col("depth") % (2 * s) < s) & (F.col("n_last") >= block * 2 * s + s)).select("conv_id", block.alias("block"), "depth", "name")
        grafts = upper.join(roots, ["conv_id", "block"]).select("depth", "name", *summed)
        totals = reliable(totals.unionByName(grafts).groupBy("depth", "name").agg(*(F.sum(c).alias(c) for c in summed)))
        s *= 2
    return totals


def prefix_trie(paths: DataFrame) -> DataFrame:
    """One row a node: conv_id (its name), depth, parent_conv_id, n_convs, n_children, n_leaves, saved (of weights), ends_sha256.

    paths has conv_id, depth, item, weight and ends; each path has a row of depth 0, and each depth up to its last.
    """
    columns_of(paths, "conv_id depth item weight ends")
    paths = reliable(paths)
    longest = paths.agg(F.max("depth")).first()[0] or 0
    size = 1 << int(longest).bit_length()
    names = named(paths, size)
    rows = names.join(paths.drop("item"), ["conv_id", "depth"])
    rows = reliable(rows)
    above = rows.where("conv_id = name").select("conv_id", (F.col("depth") - 1).alias("depth"), "weight", "n_convs")
    # a node is a row of its own namesake; the row above it, of the same path, has its parent's name
    nodes = rows.select("conv_id", "depth", F.col("name").alias("parent")).join(above, ["conv_id", "depth"], "right")
    nodes = reliable(nodes.select((F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("name"), "parent", "n_convs", ((F.col("n_convs") - 1) * F.col("weight")).alias("saved")))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = reliable(nodes.join(children, ["depth", "name"], "left").fillna(0, ["n_children"]))
    owners = nodes.groupBy(F.col("name").alias("conv_id")).agg(F.max("depth").alias("n_last"))  # only paths that name a node lead upwards
    totals = grafted(nodes.select("depth", "name", (F.col("n_children") == 0).cast("long").alias("n_leaves"), "saved"), reliable(rows.select("conv_id", "depth", "name").join(owners, "conv_id")), size, ("n_leaves", "saved"))
    result = nodes.drop("saved").join(totals, ["depth", "name"]).join(ends(rows.where("ends")), ["depth", "name"], "left")
    return result.select(F.col("name").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def op13_prefix_trie(spark, folder: str) -> DataFrame:
    turns, convs = numbered_turns(spark.read.parquet(f"{folder}/conversations.parquet"))
    return prefix_trie(rebuilt(turns, convs)).withColumnRenamed("saved", "saved_tokens")


OP13_SQL = f"""
with crc as ({CRC32_TABLE_SQL}),
o as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) n, coalesce(role, '') role, coalesce(text, '') text from conversations where conv_id is not null),
c as (select conv_id, count(*) n_turns, {crc32_sql("conv_id::varchar", "any_value(crc)")} % {SHARED} h from o, crc group by conv_id),
k as (select c.conv_id, c.h, least(c.h, coalesce(g.n_turns, 0)) k, g.conv_id giver, greatest(c.n_turns - c.h, 0) + least(c.h, coalesce(g.n_turns, 0)) size from c left join c g on g.conv_id = c.conv_id - c.conv_id % {HUNDRED}),
r as (select conv_id, n - h + k d, role, text from o join k using (conv_id) where n > h
  union all select k.conv_id, n, role, text from k join o on o.conv_id = k.giver and n <= k.k),
p as (select conv_id, d, string_agg(sha256(length(role) || ':' || role || text), '') over (partition by conv_id order by d) path, length(text) weight from r
  union all select conv_id, 0, '', 0 from c),
n as (select d, path, min(conv_id) name, count(*) n_convs, min(weight) weight from p group by d, path),
ch as (select d - 1 d, path[:-65] path, count(*) n_children from n where d > 0 group by all),
m as (select n.*, coalesce(n_children, 0) n_children from n left join ch using (d, path)),
t as (select p.d, p.path, sum((m.n_convs - 1) * m.weight) saved, sum((m.n_children = 0)::int) n_leaves from m join p on p.conv_id = m.name and p.d <= m.d group by p.d, p.path),
e as (select p.d, p.path, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) ends from p join k using (conv_id) where p.d = k.size group by p.d, p.path)
select m.name conv_id, m.d::bigint depth, u.name parent_conv_id, m.n_convs::bigint n_convs, m.n_children::bigint n_children, t.n_leaves::bigint n_leaves, t.saved::bigint saved_tokens, coalesce(e.ends, sha256('')) ends_sha256
from m join t using (d, path) left join e using (d, path) left join m u on u.d = m.d - 1 and u.path = m.path[:-65]"""
