"""Literal facts and requests: resolution edge cases, intervals, the rate cap and its streaming twin."""

import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from eventgraph.operators import bitemporal as bt
from eventgraph.streaming import limits, windows

SCHEMA = "fact_id string, subject int, predicate string, value string, valid_from timestamp_ntz, valid_to timestamp_ntz, source_authority double, confidence double"


def facts(spark, *rows):
    at = lambda y: datetime.datetime(y, 1, 1) if y else None
    return spark.createDataFrame([(i, 1, "p", v, at(y), None, a, 1.0) for i, v, a, y in rows], SCHEMA)


@pytest.mark.parametrize(
    ("rows", "reason", "winner", "lost"),
    [
        ([("a", "A", 0.9, None), ("b", "A", 0.8, None), ("c", "B", 0.1, None)], "no_conflict", "a", 0),
        ([("a", "A", 0.90005, 2001), ("b", "B", 0.9, 2005)], "valid_from_timestamp", "b", 1),
        ([("a", "A", 0.5, None), ("b", "B", 0.5, 2001)], "valid_from_timestamp", "b", 1),
        ([("a", "A", 0.5, None), ("b", "B", 0.5, None)], "unresolved_tie", None, 0),
        ([("a", "A", 0.9, None), ("b", "B", 0.5, 2001), ("c", "B", 0.4, None)], "authority", "a", 2),
        ([("a", "A", 0.9, None)], "single", "a", 0),
    ],
)
def test_resolution(spark, rows, reason, winner, lost):
    r = bt.resolve(facts(spark, *rows)).first()
    assert (r.reason, r.winner, r.n_superseded) == (reason, winner, lost)


def test_edges_drop_self_edges(spark):
    rows = facts(spark, ("e1#a", "A", 0.9, None), ("e2#b", "B", 0.5, None), ("e1#c", "C", 0.4, None))
    assert [(r.src, r.dst) for r in bt.conflict_edges(rows, bt.resolve(rows)).collect()] == [("e2", "e1")]


@pytest.mark.parametrize(("a", "c", "low", "high"), [(0.98, 1.0, 0.703, 1.0), (0.45, 0.8, 0.01, 0.71), (0.0, 1.0, 0.0, 0.4)])
def test_interval(spark, a, c, low, high):
    r = spark.range(1).select(bt.confidence_interval(F.lit(a), F.lit(c)).alias("c")).select("c.*").first()
    assert (r.low, r.high) == (low, high)


def test_overlap(spark):
    d = lambda y: F.lit(datetime.datetime(y, 1, 1))
    r = spark.range(1).select(bt.overlaps(d(2020), d(2024), d(2024), d(2028)).alias("a"), bt.overlaps(d(2020), d(2024), d(2025), d(2029)).alias("b"), bt.overlaps(F.lit(None).cast("timestamp"), d(2024), d(2023), F.lit(None).cast("timestamp")).alias("c")).first()
    assert tuple(r) == (True, False, True)


def test_times(spark):
    at, day = datetime.datetime(2001, 2, 3, 4, 5, 6), datetime.datetime(2001, 2, 3)
    texts = {"2001": datetime.datetime(2001, 1, 1), "1700": datetime.datetime(1700, 1, 1), "2001-02-03T04:05:06Z": at, "2001-02-03T05:05:06+01:00": at, " 2001-02-03 04:05:06": at, "2001-02-03": day, "20010203": day, "3 February 2001": None, "nothing": None, "981173106": None, "": None, None: None}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(bt.parse_time(F.col("t")).alias("v")).collect()
    assert [r.v for r in rows] == list(texts.values())
    numbers = {1896.0: datetime.datetime(1896, 1, 1), 2200.0: datetime.datetime(2200, 1, 1), 5.0: datetime.datetime(1970, 1, 1, 0, 0, 5), 981173106.0: at}
    rows = spark.createDataFrame([(n,) for n in numbers], "n double").select(bt.time_of_number(F.col("n")).alias("v")).collect()
    assert [r.v for r in rows] == list(numbers.values())


def test_written_back(spark):
    at = datetime.datetime(2001, 1, 1)
    facts = spark.createDataFrame([("e1#a", 1, "p", "A", at, None, 0.9, 1.0), ("e2#a", 1, "p", "B", at, None, 0.5, 1.0), ("e3#a", 1, "p", "A", at, None, 0.4, 1.0), ("e4#a", 2, "p", "C", at, None, 0.9, 1.0)], SCHEMA)
    resolved = bt.resolve(facts)
    marked = bt.superseded(facts, resolved)
    assert {r.fact_id: r.superseded_by for r in marked.collect()} == {"e1#a": None, "e2#a": "e1#a", "e3#a": None, "e4#a": None}
    assert [tuple(r) for r in bt.superseded_events(marked).collect()] == [("e2", "e1")]
    (shift,) = bt.strategy_shifts(marked, resolved).collect()
    assert shift.changed and '"winner_fact_id":"e1#a","superseded_fact_ids":["e2#a"]' in shift.event


SEQUENCE = [(0, True), (10, True), (20, False), (3600, True), (3605, False), (3611, True)]


def test_refusals_do_not_count(spark):
    rows = spark.createDataFrame([(i, 7, float(t)) for i, (t, _) in enumerate(SEQUENCE)], "request_id long, client long, at double")
    got = {r.request_id: r.accepted for r in limits.capped(rows, per_hour=2).collect()}
    assert [got[i] for i in range(len(SEQUENCE))] == [ok for _, ok in SEQUENCE]
    left = limits.snapshot(rows, limits.capped(rows, per_hour=2), 3611.0, per_hour=2).first()
    assert (left.spent_today, left.visitors_last_hour, left.daily_cap, left.hourly_cap_per_visitor) == (4, 1, 100, 2)


def one_by_one(rows, per_hour, per_day):
    """All requests in order of time, with one counter for the day and the accepted times of each client."""
    day, spent, times, out = None, 0, {}, {}
    for request, client, at in sorted(rows, key=lambda r: (r[2], r[0])):
        if at // 86400 != day:
            day, spent = at // 86400, 0
        recent = [t for t in times.get(client, []) if t > at - 3600]
        out[request] = (not per_day or spent < per_day) and (not per_hour or len(recent) < per_hour)
        if out[request]:
            spent += 1
            recent.append(at)
        times[client] = recent
    return out


@pytest.mark.parametrize(("per_hour", "per_day"), [(2, 25), (1, 12), (3, 0), (0, 20), (0, 0), (1, 1000)])
def test_caps_of_all_clients_together(spark, per_hour, per_day):
    """Both caps reached, days in a row, and a client with a third of all requests; 0 switches a cap off."""
    r = random.Random(per_day)
    near_midnight = lambda: r.choice([r.uniform(0, 86400), r.uniform(84000, 90000), r.uniform(84000, 90000)])
    rows = [(i, r.choice([0, 0, 0, 1, 2, 3, 4, 5, 6]), round(86400 * r.randrange(4) + near_midnight())) for i in range(400)]
    df = spark.createDataFrame([(i, c, float(t)) for i, c, t in rows], "request_id long, client long, at double").repartition(5)
    got = {x.request_id: x.accepted for x in limits.capped(df, per_hour, per_day).collect()}
    assert got == one_by_one(rows, per_hour, per_day)


def test_requests_without_client_or_time(spark):
    rows = spark.createDataFrame([(1, None, 5.0), (2, None, 6.0), (3, 1, None), (4, 1, 7.0)], "request_id long, client long, at double")
    assert {x.request_id: x.accepted for x in limits.capped(rows, 1, 9).collect()} == {1: True, 2: False, 3: False, 4: True}
    assert limits.capped(rows.limit(0)).count() == 0


def test_day_cap(spark):
    rows = spark.createDataFrame([(i, i % 3, i * 4000.0) for i in range(25)], "request_id long, client long, at double")
    got = [r.accepted for r in limits.capped(rows, per_day=5).orderBy("request_id").collect()]
    assert got[:6] == [True] * 5 + [False]
    assert got[22]  # the next day


def test_streaming_twin(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [(i, 7, float(t)) for i, (t, _) in enumerate(SEQUENCE)]
    schema = "request_id long, client long, at double"
    for k, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame(pd.DataFrame(part, columns=["request_id", "client", "at"]), schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).json(f"{tmp_path}/in")
        q = limits.capped_stream(stream, per_hour=2, expire=False).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        assert q.awaitTermination(60)
        assert q.exception() is None
    hours = {r.request_id: r.accepted for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert [hours[i] for i in range(len(SEQUENCE))] == [ok for _, ok in SEQUENCE]
    decided = spark.readStream.schema("request_id long, client long, at double, accepted boolean").parquet(f"{tmp_path}/out")
    q = limits.day_capped_stream(decided, per_day=3, expire=False).writeStream.format("parquet").option("path", f"{tmp_path}/days").option("checkpointLocation", f"{tmp_path}/cp2").trigger(availableNow=True).start()
    assert q.awaitTermination(60) and q.exception() is None
    states = spark.read.format("statestore").option("stateVarName", "day").load(f"{tmp_path}/cp2")  # the snapshot of a running cap
    assert [x.value.spent for x in states.collect()] == [3]
    assert spark.read.parquet(f"{tmp_path}/days").where("accepted").count() == 3


def test_windows_on_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(datetime.datetime(2024, 1, 1, 0, m), 1, 2.0) for m in (1, 2, 40)], "ts timestamp, user_id int, value double")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = windows.tumbling(stream, "10 minutes", ["user_id"]).writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.n for r in spark.table("tumbled").collect()) == [1, 2]
    assert sorted(r.n for r in windows.tumbling(rows, "10 minutes", ["user_id"]).collect()) == [1, 2]
