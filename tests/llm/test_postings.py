"""The positional index against a plain search of every text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from eventgraph.llm import postings

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def plain(docs, items, width):
    """n_words, n_hit and items of each text, by comparing every place with every window."""
    wanted = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - width, 0) + 1 if w else 0):
            wanted.setdefault(tuple(w[i : i + width]), set()).add("" if item is None else str(item))
    lengths, out = {len(w) for w in wanted}, []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if owners := wanted.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= owners
        out.append((doc, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def made(seed):
    r = random.Random(seed)
    docs = [(i, " ".join(r.choice(["the", "a", "of", "Tree", "sea", "ééé", "42", "x-y"]) for _ in range(r.randrange(80)))) for i in range(120)]
    items = [(k, " ".join(r.choice(["the", "a", "of", "tree", "sea", "ééé", "42", "x", "y"]) for _ in range(r.choice([0, 1, 2, 3, 6, 9])))) for k in range(40)]
    return docs, items


@pytest.mark.parametrize("pass_bytes", [1 << 20, 120])
def test_phrases(spark, monkeypatch, pass_bytes):
    monkeypatch.setattr(postings, "PASS_BYTES", pass_bytes)
    monkeypatch.setattr(postings, "PIECE", 2)
    docs, items = made(3)
    docs += [(None, None), (7, ""), (8, " .. !"), (9, docs[0][1]), (9, docs[0][1]), (10, "the sea " * 40000)]
    items += [(None, "of of of"), (5, None), (6, "a tree a"), (6, "sea sea")]
    rows = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, n_words int, block int").repartition(3)
    got = postings.phrases(postings.build(rows), spark.createDataFrame(items, "item_id long, text string"), 4).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got], key=repr) == plain(docs, items, 4)
    for r in got:  # spans are the hit words
        assert r.n_hit == len({i for s in r.spans for i in range(s.start, s.end)}) and all(s.end <= r.n_words for s in r.spans)


def test_proximity(spark):
    docs, items = made(4)
    got = {(r.doc_id, r.item_id): r.n_words for r in postings.near(postings.build(spark.createDataFrame(docs, "doc_id long, text string")), spark.createDataFrame(items, "item_id long, text string"), 12).collect()}
    want = {}
    for doc, text in docs:
        w = words(text)
        for item, phrase in items:
            s = set(words(phrase))
            best = min((n for n in range(1, 13) for i in range(len(w) - n + 1) if s and s <= set(w[i : i + n])), default=None)
            if best:
                want[doc, str(item)] = best
    assert got == want and want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "the sea")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "the sea")], "item_id long, text string")
    assert postings.phrases(postings.build(none), items).count() == 0
    row = postings.phrases(postings.build(some), items.where("false")).first()
    assert (row.n_words, row.n_hit, row["items"]) == (2, 0, [])


def test_packed_numbers():
    import numpy as np

    steps = np.array([0, 1, 127, 128, 16383, 16384, 1 << 21, (1 << 28) - 1, 1 << 28, (1 << 32) - 1])
    data, ends = postings.packed(steps)
    assert (postings.unpacked(data) == np.cumsum(steps)).all() and ends[-1] == len(data)
    assert not len(postings.unpacked(postings.packed(steps[:0])[0]))


def test_no_shuffle_of_postings(spark, folder):
    """Building the index and searching it move no text and no list between tasks."""
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    index = postings.build(docs)
    plan = postings.phrases(index, items)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert index.agg(F.sum(F.size("docs"))).first()[0] == docs.count()
