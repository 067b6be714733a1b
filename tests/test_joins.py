"""Joins by similar sets, shared time and texts within texts, against comparing all pairs."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from eventgraph.operators import setjoin


def sets(spark, rows):
    return spark.createDataFrame(rows, "row_id long, group string, tokens array<string>")


@pytest.mark.parametrize("least", [0.4995, 0.8])
def test_similar_sets(spark, least):
    r = random.Random(7)
    made = lambda n: [(i, r.choice("xy"), sorted(set(r.choices("abcdefghijkl", k=r.randrange(0, 7))) | ({"all"} if r.random() < 0.9 else set()))) for i in range(n)]
    left, right = made(80), made(90) + [(400, None, ["a"])]
    got = {(x.left.row_id, x.right.row_id): x.n for x in setjoin.similar_pairs(sets(spark, left), sets(spark, right), least).collect()}
    want = {}
    for i, g, a in left:
        for j, h, b in right:
            n = len(set(a) & set(b))
            if g == h and n and 2 * n >= least * (len(a) + len(b)):
                want[i, j] = n
    assert got == want and want


def test_a_token_of_all_rows_joins_no_pairs(spark):
    """Candidates stay in proportion to the rows when one token is in all of them."""
    counts = []
    for n in (200, 400):
        rows = sets(spark, [(i, "", ["all", f"a{i}", f"b{i}"]) for i in range(n)])
        each = setjoin.keyed(rows, rows.select(F.explode("tokens").alias("token")).groupBy("token").count().withColumnRenamed("count", "n"), 0.5)
        other = each.select(F.col("row_id").alias("row_id_2"), "token", F.col("own").alias("other"), F.col("other").alias("own"))
        counts.append(each.join(other, ["token", "own", "other"]).count())
    assert counts[1] == 2 * counts[0] < 8 * 400
    assert setjoin.similar_pairs(rows, rows, 0.5).count() == 400


@pytest.mark.parametrize("width", [3600, 86400 * 40])
def test_overlapping_intervals(spark, width):
    """Open and reversed bounds, and a key with a third of all rows."""
    r, day = random.Random(9), datetime(2020, 1, 1)

    def bound():
        return None if r.random() < 0.15 else day + timedelta(hours=r.randrange(200))

    rows = [(i, r.choice([1, 1, 1, 2, 3, 4, 5, 6, 7]) if i % 10 else None, bound(), bound()) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, k long, start timestamp, end timestamp")
    got = [(x.left.id, x.right.id) for x in setjoin.overlapping(df, df, ["k"], width).collect()]
    le = lambda a, b: a is None or b is None or a <= b
    want = {(a[0], b[0]) for a in rows for b in rows if a[1] is not None and a[1] == b[1] and le(a[2], b[3]) and le(b[2], a[3])}
    assert len(got) == len(set(got)) and set(got) == want
    assert setjoin.overlapping(df.limit(0), df, ["k"], width).count() == 0


def test_a_common_key_is_many_groups(spark):
    """A key with a third of the rows meets itself stretch by stretch: pairs looked at stay near those that overlap."""
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.timestamp_seconds(F.col("id") * 3600).alias("start"), F.timestamp_seconds(F.col("id") * 3600 + 1800).alias("end"))
    pairs = setjoin.overlapping(df, df, ["k"], 3600 * 10)
    assert pairs.count() == 3000
    assert "_stretch" in pairs._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("pass_bytes", [1 << 20, 9])
def test_texts_within_texts(spark, monkeypatch, pass_bytes):
    monkeypatch.setattr(setjoin, "PASS_BYTES", pass_bytes)
    r = random.Random(4)
    made = lambda n: ["".join(r.choices("abé", k=r.randrange(0, 6))) for _ in range(n)]
    asked, texts = made(40) + [None], made(60) + [None, "abé" * 5000]
    frame = lambda v: spark.createDataFrame([(x,) for x in v], "v string")
    got = sorted(tuple(x) for x in setjoin.contained(frame(asked), frame(texts)).collect())
    assert got == sorted({(a, t) for a in asked if a for t in texts if t and (a in t or t in a)})
    assert setjoin.contained(frame([]), frame(texts)).count() == 0
