"""Runs of words against a comparison of all pairs of places."""

import hashlib
import random
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from eventgraph.llm import runs


def plain(w):
    """Every stretch with equal words q apart, for every q, less those with a smaller period."""
    found = []
    for q in range(1, len(w) // 4 + 1):
        i = q
        while i < len(w):
            start = i
            while i < len(w) and w[i] == w[i - q]:
                i += 1
            if i - start + q >= max(6, 4 * q) and i > start:
                found.append((start - q, i - start + q, q))
            i += 1
    return sorted((r for r in found if not any(o[2] < r[2] and o[0] <= r[0] and o[0] + o[1] >= r[0] + r[1] for o in found)), key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 4), st.lists(st.integers(0, 3), max_size=70), st.integers(1, 9), st.integers(0, 60))
def test_random_sequences(kinds, head, period, tail):
    w = [x % kinds for x in head] + [(i % period) * 7 % kinds for i in range(tail)]
    assert runs.runs_of(w) == plain(w)


def test_hard_sequences():
    fibonacci = [0]
    for _ in range(12):
        fibonacci = [y for x in fibonacci for y in ((0, 1) if x == 0 else (0,))]
    thue = [bin(i).count("1") % 2 for i in range(512)]
    for w in (fibonacci, thue, thue * 4, [0] * 900, [0, 1] * 300 + [1] * 100, list(range(100)) * 4, list(range(100)) * 4 + [7]):
        assert runs.runs_of(w) == plain(w)
    assert runs.runs_of([5] * 100_000) == [(0, 100_000, 1)]


def test_narrowing_loses_nothing():
    r = random.Random(5)
    for _ in range(300):
        w = [r.randrange(r.choice([2, 5, 40])) for _ in range(r.randrange(200))]
        w += w[-r.randint(1, 30) :] * r.randint(0, 5)
        assert runs.runs_of(w) == sorted(((s, e - s + 1, q) for (s, q), e in runs.repeats(w).items()), key=lambda x: (x[0], x[2]))


def test_whole_table(spark, folder):
    """Every row of the query, from its contract's words."""
    from eventgraph.llm.queries import QUERIES

    got = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, folder).collect()}
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(got)
    some = 0
    for doc, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", text or "")
        h = zlib.crc32(str(doc).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = plain(w)
        gone = {i for s, length, q in found for i in range(s + q, s + length)}
        x = got[doc]
        assert x.n_runs == len(found)
        assert x.runs_sha256 == hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()).hexdigest()
        assert x.collapsed_sha256 == hashlib.sha256(" ".join(v for i, v in enumerate(w) if i not in gone).encode()).hexdigest()
        if found:
            some += 1
            s, length, q = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]))
            assert (x.start, x.length, x.period, x.exponent_milli) == (s, length, q, 1000 * length // q)
        else:
            assert (x.start, x.length, x.period, x.exponent_milli) == (None,) * 4
    assert some


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a " * 6), (4, "a " * 5), (5, "b a a a a a a c"), (5, "b a a a a a a c"), (6, "é x " * 30000)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "id long, text string, runs int, Collapsed string")
    found = runs.find_runs(df).collect()
    want = {1: ([], ""), 2: ([], ""), 3: ([], ""), None: ([(0, 6, 1)], "a"), 4: ([], "a a a a a"), 5: ([(1, 6, 1)], "b a c"), 6: ([(0, 60000, 2)], "é x")}
    assert len(found) == len(rows) and set(df.columns) - {"Collapsed"} <= set(found[0].asDict())
    for r in found:
        assert ([tuple(x) for x in r.runs], r.collapsed) == want[r.id]
    assert runs.find_runs(df.where("false")).count() == 0
