"""Composite tools, table functions and order statistics on literal rows."""

import random

import pytest
from pyspark.sql import functions as F

from eventgraph.functions import tools
from eventgraph.operators import agent, metrics, toolkit, views

EVENTS = "event_id long, name string, label string, sport string, year int, season string, gender string, venue string, start_date string, gold_athlete string, competitor_count int"


@pytest.fixture(scope="module")
def events(spark):
    rows = [
        (1, "Luge at the 1994 Winter Olympics – Singles", "Singles", "Luge", 1994, "Winter", "Men", "Hunder", "13 February", "Georg", 30),
        (2, "Luge at the 1998 Winter Olympics – Singles", "Singles", "Luge", 1998, "Winter", "Men", "Spiral", "8 February", "Hackl", 34),
        (3, "Luge at the 1998 Winter Olympics – Doubles", "Doubles", "Luge", 1998, "Winter", "Mixed", "Spiral", "13 February", "Krausse", 34),
        (4, "Luge at the 2002 Winter Olympics – Singles", "Singles", "Luge", 2002, "Winter", "Men", "Park", "10 February", "Zoeggeler", 0),
        (5, "Luge at the 2002 Winter Olympics – Doubles", "Doubles", "Luge", 2002, "Winter", "Mixed", "Park", "15 February", "Leitner", 20),
    ]
    return spark.createDataFrame(rows, EVENTS)


def test_ties_that_one_article_breaks(spark, events):
    ranked = toolkit.rank_events(events.where("year = 1998"), ["sport", "year"])
    chunk = lambda doc, text: (doc, 0, text)
    for said, want in {("There were 34 lugers.", "Few came."): [(2, 1)], ("34 lugers.", "34 sleds."): [(2, 2), (3, 2)], ("None.", "340 came."): [(2, 2), (3, 2)]}.items():
        chunks = spark.createDataFrame([chunk(d, t) for d, t in zip((2, 3), said)], "doc_id long, chunk_index int, text string").withColumn("raw_text", F.col("text"))
        got = toolkit.ties_broken(ranked, chunks, ["sport", "year"])
        assert sorted((r.event_id, r.n_tied) for r in got.collect()) == want


def test_edition_before_by_edge_or_by_year(spark, events):
    asked = spark.createDataFrame([(10, "Luge at the 1998 Winter Olympics – Singles", None, None, None, None), (11, "Luge at the 2002 Winter Olympics – Doubles", None, 2002, None, None)], "question_id long, phrase string, sport string, year int, season string, gender string")
    precedes = spark.createDataFrame([(2, 1)], "src long, dst long")
    got = {r.question_id: (r.event_id, r.value, r.traversal) for r in toolkit.previous_or_linked(asked, events, precedes, "gold_athlete").collect()}
    assert got[10] == (1, "Georg", "PRECEDES")
    assert got.get(11) in (None, (3, "Krausse", "previous_games"))


def test_ties_worth_reporting(spark):
    rows = spark.createDataFrame([(True, ["a", "b"], "venue", "venue"), (True, list("abcdefg"), "venue", "venue"), (False, ["a"], "venue", "venue"), (True, ["a"], "venue", "date"), (True, ["a"], None, None)], "m boolean, c array<string>, k string, a string")
    assert [r[0] for r in rows.select(agent.reportable_tie(F.col("m"), F.col("c"), F.col("k"), F.col("a"))).collect()] == [True, False, False, False, True]
    assert agent.presets(spark.createDataFrame([(1, "q", "t", "secret")], "qid long, question string, qtype string, answer string")).columns == ["qid", "question", "qtype"]


def test_tools_as_table_functions(spark, events):
    tools.register(events)
    one = lambda text: sorted(tuple(r) for r in spark.sql(text).collect())
    assert one("select year, n from count_events(30) order by year") == [(1994, 0), (1998, 2), (2002, 0)]
    assert one("select event_id, n_tied from leading_events(true) where year = 1998") == [(2, 2), (3, 2)] and one("select event_id from leading_events(false) where year = 2002") == [(5,)]
    assert one("select event_id from events_at('SPIRAL!', '8 February')") == [(2,)] and one("select event_id from find_events('Luge', 2002, null)") == [(4,), (5,)]
    assert tools.missing({"a", "b"}, {"b", "c"}) == ["a"]


@pytest.mark.parametrize("shape", ["spread", "hot", "tiny", "whole"])
def test_nearest_rank(spark, shape):
    """Values apart, a third of them equal, values very close to each other beside a far one, and whole numbers."""
    r = random.Random(3)
    make = {"spread": lambda: r.uniform(-5, 5), "hot": lambda: r.choice([2.0, r.random(), r.random() * 9]), "tiny": lambda: r.choice([1e9, 1 + r.random() * 1e-9, 1 + r.random() * 1e-9]), "whole": lambda: float(r.randrange(7))}[shape]
    rows = [(r.choice(["a", "b", None]), make()) for _ in range(500)] + [("one", 3.0), ("none", None)]
    shares = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {x.k: tuple(x[s] for s in shares) for x in metrics.nearest_rank(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", shares).collect()}
    want = {}
    for k in {k for k, v in rows if v is not None}:
        ordered = sorted(v for key, v in rows if key == k and v is not None)
        want[k] = tuple(ordered[min(len(ordered) - 1, round(s * (len(ordered) - 1)))] for s in shares.values())
    assert got == want


def test_batches_in_order_of_any_key(spark):
    for rows, kind in (([f"k{i:03}" for i in range(95)], "string"), ([i * 7 for i in range(95)], "long")):
        got = views.batches(spark.createDataFrame([(x, 1) for x in rows], f"key {kind}, x int").repartition(6), "key", 10).collect()
        assert sorted((r.key, r.batch) for r in got) == [(x, i // 10) for i, x in enumerate(sorted(rows))]
    assert {r.batch for r in views.batches(spark.range(5), "id", 0).collect()} == {0}
