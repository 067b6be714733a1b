"""The stored index, snapshots and the inverted file of vectors."""

import random

import pytest
from pyspark.sql import functions as F

from eventgraph.operators import neighbours, retrieval, text_index
from eventgraph.plans import registry, text_queries
from eventgraph.session import shared_folder
from eventgraph.sources.snapshots import Snapshots

SCHEMAS = {"a": "k long, v string", "b": "n long"}


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_readers_keep_their_snapshot(spark):
    store = Snapshots(spark, shared_folder(spark, "store"), SCHEMAS)
    make = lambda *r: spark.createDataFrame(list(r), SCHEMAS["a"])
    assert rows(store.read("a")) == []
    one = store.commit(append={"a": make((1, "x"))}, info={"by": "me"})
    before = store.read("a")
    two = store.commit(append={"a": make((2, "y")), "b": spark.createDataFrame([(5,)], SCHEMAS["b"])}, info={"step": "2"})
    assert rows(before) == rows(store.read("a", one)) == [(1, "x")] and rows(store.read("a")) == [(1, "x"), (2, "y")]
    assert rows(store.read("b", one)) == [] and rows(store.read("b", two)) == [(5,)]
    store.upsert("a", make((2, "z"), (3, "n"), (3, "m")), ["k"])
    assert rows(store.read("a")) == [(1, "x"), (2, "z"), (3, "n")] and rows(store.read("a", two)) == [(1, "x"), (2, "y")]
    assert dict(store.latest()["info"]) == {"by": "me", "step": "2"}
    with pytest.raises(ValueError):
        store.read("a", 99)


def test_a_commit_that_fails_in_the_middle_leaves_the_old_state(spark):
    store = Snapshots(spark, shared_folder(spark, "store"), SCHEMAS)
    store.commit(append={"a": spark.createDataFrame([(1, "x")], SCHEMAS["a"]), "b": spark.createDataFrame([(1,)], SCHEMAS["b"])})
    bad = spark.range(4).select(F.when(F.col("id") < 3, F.col("id")).otherwise(F.raise_error(F.lit("lost"))).cast("long").alias("n"))
    with pytest.raises(Exception, match="lost"):  # the first table's part is written by then
        store.commit(append={"a": spark.createDataFrame([(2, "y")], SCHEMAS["a"]), "b": bad})
    assert rows(store.read("a")) == [(1, "x")] and rows(store.read("b")) == [(1,)] and store.latest()["version"] == 1
    other = Snapshots(spark, store.folder, SCHEMAS)
    other.commit(replace={"b": spark.createDataFrame([(9,)], SCHEMAS["b"])})
    assert rows(store.read("b")) == [(9,)] and rows(store.read("a")) == [(1, "x")]


@pytest.mark.parametrize("span", [4, 4096])
def test_index_equals_the_scan(spark, monkeypatch, span):
    monkeypatch.setattr(text_index, "SPAN", span)
    r = random.Random(span)
    words = ["the"] * 8 + ["of", "sea", "Tree", "ship", "æon", "rare", "x1"]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.randrange(1, 30)))) for i in range(150)] + [(500, None), (501, ""), (502, "the sea " * 3000)]
    asked = spark.createDataFrame([(1, "the sea"), (2, "rare rare tree"), (3, "unknown"), (4, "x1 of ship"), (5, None)], "query_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    index = text_index.TextIndex(spark, shared_folder(spark, "index"))
    assert index.search(asked, 5).count() == 0
    index.add(frame.where("doc_id < 90"))
    first = index.add(frame.where("doc_id >= 90"))
    index.add(frame)  # all are there
    for k in (1, 7, 400):
        assert rows(index.search(asked, k)) == rows(retrieval.bm25(asked, frame, k).select("query_id", "doc_id", "score", "rank"))
    some = frame.where("doc_id % 3 = 0")
    assert rows(index.search(asked, 7, some.select("doc_id"))) == rows(retrieval.bm25(asked, frame, 7, F.col("doc_id") % 3 == 0).select("query_id", "doc_id", "score", "rank"))
    more = spark.createDataFrame([(900, "sea sea sea")], "doc_id long, text string")
    index.add(more)
    assert rows(index.search(asked, 3, version=first)) == rows(retrieval.bm25(asked, frame, 3).select("query_id", "doc_id", "score", "rank"))
    assert rows(index.search(asked, 30)) == rows(retrieval.bm25(asked, frame.unionByName(more), 30).select("query_id", "doc_id", "score", "rank"))


def test_spans_are_skipped(spark, folder):
    """Block bounds leave out most of what a query's tokens have."""
    text_index_ = text_index.TextIndex(spark, shared_folder(spark, "index"))
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.concat(F.lit("common "), F.when(F.col("id") < 40, "sea sea sea").otherwise(F.concat(F.lit("w"), F.col("id").cast("string")))).alias("text"))
    before, text_index.SPAN = text_index.SPAN, 256
    try:
        text_index_.add(docs.coalesce(2))
        blocks = text_index_.blocks(spark.createDataFrame([(1, "common sea")], "query_id long, text string"))
        kept = text_index_.candidates(blocks, 10)
        assert blocks.count() > 70 and kept.count() < 8
    finally:
        text_index.SPAN = before


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_recall_of_the_inverted_file(spark, size):
    data = f"/root/testdata/{size}"
    want = {(r.query_id, r.id) for r in text_queries.near(spark, data, 10).collect()}
    got = {(r.query_id, r.id) for r in registry.QUERIES["inverted_file_topk"](spark, data).collect()}
    assert len(want & got) >= 0.9 * len(want)


def test_neighbours_of_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PASS", 3)
    monkeypatch.setattr(neighbours, "PART", 50)
    r = random.Random(2)
    some = [(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(120)] + [(200 + i, [1.0] + [0.0] * 5) for i in range(300)]  # one hot vector
    odd = [(900, None), (901, [0.0] * 6), (902, [float("nan")] * 6), (903, [1.0, 2.0])]
    vectors = spark.createDataFrame(some + odd, "id long, vector array<float>")
    asked = spark.createDataFrame([(i, v) for i, v in some[:8]] + [(300, some[150][1]), (901, odd[1][1])], "query_id long, vector array<float>")

    def cosine(a, b):
        return round(sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) ** 0.5 * sum(y * y for y in b) ** 0.5), 5)

    def plain(k):
        f32 = {i: [float(F32(x)) for x in v] for i, v in some}
        return {q: [i for i, _ in sorted(((i, cosine(f32[q if q in f32 else 200], v)) for i, v in f32.items()), key=lambda p: (-p[1], p[0]))[:k]] for q in [*range(8), 300]}

    from numpy import float32 as F32

    def listed(df):
        out = {}
        for x in df.orderBy("query_id", "rank").collect():
            out.setdefault(x.query_id, []).append(x.id)
        return out

    index = neighbours.Neighbours(spark, shared_folder(spark, "file"))
    index.build(vectors.where("size(vector) = 6 or vector is null"), 5)
    assert listed(neighbours.exact(asked, vectors.where("id <> 903"), 4)) == plain(4) == listed(index.search(asked, 4, 5))
    assert neighbours.exact(asked.limit(0), vectors, 4).count() == 0 and index.search(asked.limit(0), 4, 2).count() == 0
    plan = index.search(asked, 4, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "Join Cross" not in plan


def test_words_of_blocks_are_those_of_search_tokens(spark):
    import pyarrow as pa

    from eventgraph.functions import text as tx
    from eventgraph.operators import scoring

    texts = ["ﬁnal Ａthens", "Ⅻ ½ km² №7 ﬀoﬄe", "Süleymanoğlu—Łódź Øre", "ｆｕｌｌ ㎏ …", "ǅ ǆ Ǳ", " plain\tTEXT\x00x ", "", "中文 é", "𝐀b 😀c", "a´b ́x ￾", "İı ſ K", "".join(map(chr, range(1, 0x2FFF))), "".join(map(chr, range(0xE000, 0xFFFD))), None]
    want = [r.t or [] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(tx.search_tokens("t").alias("t")).collect()]
    assert [t.split() for t in scoring.folded(pa.array(texts)).to_pylist()] == want


def test_only_the_best_of_a_task_are_shuffled(spark):
    """Words that all queries and documents share: rows that are joined or shuffled do not grow with queries times documents."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the of sea w"), F.col("id") % 7).alias("text")).repartition(2)
    asked = spark.range(40).select(F.col("id").alias("query_id"), F.concat(F.lit("the sea w"), F.col("id") % 7).alias("text"))
    index = text_index.TextIndex(spark, shared_folder(spark, "index"))
    index.add(docs)
    blocks = index.blocks(asked).localCheckpoint()
    spans = blocks.select("span").distinct().count()
    found = index._best(blocks, 5, None, index.store.read("documents"))
    assert found.count() <= 40 * 5 * spans
    got = rows(index.search(asked, 5))
    assert got == rows(retrieval.bm25(asked, docs, 5)) and len(got) == 200
    assert all(d % 7 == q % 7 for q, d, _, _ in got)


def test_rows_with_equal_and_null_ids_are_one_document(spark, monkeypatch):
    monkeypatch.setattr(text_index, "SPAN", 2)
    monkeypatch.setattr(text_index, "BLOCK", 3)
    docs = spark.createDataFrame([(i % 7 if i % 5 else None, f"sea w{i} ship" if i % 2 else "the sea") for i in range(30)] + [(40, None)], "doc_id long, text string")
    whole = docs.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list("text")), " ").alias("text"))
    asked = spark.createDataFrame([(1, "sea w3"), (2, "ship the w9"), (3, "none")], "query_id long, text string")
    index = text_index.TextIndex(spark, shared_folder(spark, "index"))
    index.add(docs)
    listed = lambda df: sorted(map(tuple, df.collect()), key=repr)
    got = listed(index.search(asked, 4))
    assert got == listed(retrieval.bm25(asked, docs, 4)) == listed(retrieval.bm25(asked, whole, 4)) and len(got) == 8
