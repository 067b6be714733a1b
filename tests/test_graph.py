"""Literal events: bounds, ties, previous editions, venues and the direction of PRECEDES."""

import datetime

import pytest

from eventgraph.operators import graph, toolkit, views

EVENTS = [
    ("C98W", "Curling at the 1998 Winter Olympics – Women's tournament", 1998, "Winter", "Curling", "Women", "Hall North", "9 to 15 February", 40, "Ines Falk", "curling women"),
    ("C02W", "Curling at the 2002 Winter Olympics – Women's tournament", 2002, "Winter", "Curling", "Women", "Hall South", "11–21 February", 50, "Mara Quist", "curling women"),
    ("C02M", "Curling at the 2002 Winter Olympics – Men's tournament", 2002, "Winter", "Curling", "Men", "Hall South", "11–22 February", 50, "Olle Brandt", "curling men"),
    ("L02S", "Luge at the 2002 Winter Olympics – Men's singles", 2002, "Winter", "Luge", "Men", "Track East", "10–11 February", 0, "Timo Reuss", "luge singles"),
    ("L06S", "Luge at the 2006 Winter Olympics – Men's singles", 2006, "Winter", "Luge", "Men", "Track West", "11 February", 36, "Jan Adler", "luge singles"),
    ("L06D", "Luge at the 2006 Winter Olympics – Men's doubles", 2006, "Winter", "Luge", "Men", "Track West", "11 February", 41, "Ott, Klee", "luge doubles"),
]
SCHEMA = "event_id string, name string, year int, season string, sport string, gender string, venue string, start_date string, competitor_count long, gold_athlete string, series_id string, event_date date, doc_id long"


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame([(*e, datetime.date(e[2], 2, 11), i) for i, e in enumerate(EVENTS)], SCHEMA)


@pytest.mark.parametrize(("comparison", "threshold", "sport", "n"), [("more_than", 45, "curling", 2), ("at_least", 40, "curling", 3), ("fewer_than", 50, "curling", 1), ("exactly", 50, "curling", 2), ("fewer_than", 40, "luge", 1), ("fewer_than", 1, "curling", 0)])
def test_counts(events, comparison, threshold, sport, n):
    assert toolkit.count_events(events, comparison, threshold, sport=sport).first()["match_count"] == n


def test_unknown_comparison():
    with pytest.raises(ValueError, match="about"):
        toolkit.bounds("about", 3)


def test_ties_are_reported(events):
    top = {(r.sport, r.year): [] for r in events.select("sport", "year").collect()}
    for r in toolkit.rank_events(events, ["sport", "year"]).collect():
        top[r.sport, r.year].append((r.event_id, r.n_tied))
    assert sorted(top["Curling", 2002]) == [("C02M", 2), ("C02W", 2)]
    assert top["Luge", 2006] == [("L06D", 1)]
    assert top["Luge", 2002] == []


def test_raw_superlative_counts_unknown(events):
    found = graph.superlative(events, sport="luge", order="asc").first()
    assert (found["event_id"], found["competitor_count"]) == ("L02S", 0)
    assert graph.superlative(events, limit=0).count() == 0


def test_chronology(events):
    got = {r.event_id: (r.prev_event_id, r.next_event_id, r.time_diff) for r in graph.chronology(events).collect()}
    assert got == {"C98W": (None, "C02W", 4), "C02W": ("C98W", None, 4), "C02M": (None, None, 0), "L02S": (None, "L06S", 4), "L06S": ("L02S", None, 4), "L06D": (None, None, 0)}


def test_precedes_points_back(events):
    edges = {(r.src, r.dst) for r in graph.edges_back(events).collect()}
    assert edges == {("C02W", "C98W"), ("L06S", "L02S")}
    found = graph.preceding(events, graph.edges_back(events), sport="curling", fragment="women's tournament", year=2002).first()
    assert found["gold_athlete"] == "Ines Falk"
    assert graph.preceding(events, graph.edges_back(events), sport="curling").count() == 0


def test_previous_year(events):
    got = {r.year: r.previous_year for r in toolkit.previous_year(events).collect()}
    assert got == {1998: None, 2002: 1998, 2006: 2002}


def test_venue_and_date(events):
    found = graph.at_venue_date(events, "track west", "11 February 2006 (Sunday)", 2006).collect()
    assert sorted(r.event_id for r in found) == ["L06D", "L06S"]
    assert graph.at_venue_date(events, "", "", 2006).count() == 0
    assert graph.clean_date(" 11 February, 2006 (a)", 2006) == "11 February"
    assert graph.venue_variants("a b c d e") == ["a b c d e", "a b c d", "a b c"]


def test_literal_percent(spark, events):
    assert graph.attributes(events, "%").count() == 0
    assert graph.attributes(events, "  ").count() == 0


def test_vocabulary(spark, events):
    wanted = spark.createDataFrame([("sport", "rowing"), ("sport", "LUGE"), ("year", "1912")], "constraint_name string, constraint_value string")
    assert sorted(r.constraint_value for r in toolkit.unmatched(wanted, events, ["sport", "year"]).collect()) == ["1912", "rowing"]


def test_merge_keeps_what_is_not_given(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, name string, venue string")
    new = spark.createDataFrame([(2, None, "z"), (3, "c", None)], "id int, name string, venue string")
    assert sorted(tuple(r) for r in graph.merge_vertices(old, new, "id").collect()) == [(1, "a", "x"), (2, "b", "z"), (3, "c", None)]


def test_weight(spark):
    from pyspark.sql import functions as F

    assert [r[0] for r in spark.createDataFrame([(3,), (400,)], "n int").select(views.weight(F.col("n"))).collect()] == [4.05, 14.19]
