"""The pipeline's stages on their own inputs, and the queries that SQL can check."""

import os
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from eventgraph.llm import classifier, mixing, pieces, queries
from tests.llm.test_operators import LIBRARY, brute_components
from tests.test_oracle import TABLES, rows


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    """The rows before the first and after each stage, each written and read again."""
    out = [spark.read.parquet(f"{folder}/documents.parquet")]
    base = tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], folder).write.parquet(f"{base}/{name}")
        out.append(spark.read.parquet(f"{base}/{name}"))
    return out


def test_columns(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns


def test_quality_keeps_good_documents(spark, folder, stages):
    before, after = ({r.doc_id: r for r in df.collect()} for df in stages[0:2])
    assert all(after[i] == before[i] for i in after)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    net = classifier.train(stages[0], labels)
    tables = net.tables()
    want = {i for i, r in before.items() if net.score(np.frombuffer((r.text or "").encode(), np.uint8), tables) >= classifier.THRESHOLD}
    assert set(after) == want
    good = [r.doc_id for r in labels.where("quality = 1").collect()]
    assert sum(i in after for i in good) >= 0.97 * len(good)


def test_one_of_each_group_stays(stages):
    before = {r.doc_id: r.text for r in stages[1].collect()}
    want = {i for i, (_, c) in brute_components(before).items() if i == c}
    assert {r.doc_id for r in stages[2].collect()} == want


def test_personal_data_goes(stages):
    marks = re.compile(r"[^\s@]+@mail\d\.example\.com|555-\d{4}|(?<!\d)\d{16}(?!\d)|[0-9a-f]{40}", re.I)
    before = {r.doc_id: r.text for r in stages[2].collect()}
    after = stages[3].collect()
    assert {r.doc_id for r in after} == set(before)
    for r in after:
        assert r.n_chars == len(r.text or "") or r.text is None
        assert not [m for m in marks.findall(before[r.doc_id] or "") if m in r.text]
        if not re.search(r"\d{3}|@|\d\.\d", before[r.doc_id] or ""):
            assert r.text == before[r.doc_id]


def test_repeats(stages):
    plan = {r.doc_id: r.repeats for r in mixing.mix(stages[3]).collect()}
    assert Counter(r.doc_id for r in stages[4].collect()) == Counter({i: n for i, n in plan.items() if n})


def test_ids(stages):
    text = {r.doc_id: r.text for r in stages[4].collect()}
    got = stages[5].collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in stages[4].collect())
    for r in got:
        assert r.ids == LIBRARY.encode(text[r.doc_id] or "", add_eos=True) and r.text == LIBRARY.decode(r.ids) and r.n_tokens == len(r.ids)
    assert pieces.default_model()


def test_run_is_the_stages(spark, folder, stages):
    assert Counter(map(str, corpus_pipeline.run(spark, folder).select("doc_id", "ids").collect())) == Counter(map(str, stages[5].select("doc_id", "ids").collect()))


ODD = [(1, "one two three four five six", "en", "a", 27), (1, "one two three four five six", "en", "a", 27), (2, None, None, None, None), (3, "", "en", "a", 0), (None, "Dr Ada Berg, 555-123-4567", "en", "b", 10), (5, "word " * 30_000 + "end", "en", "b", 150_003)]


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_odd_rows_and_clashing_names(spark, folder, name, stage):
    """Nulls, copies, a long text and columns with the names that stages use within; and an empty table."""
    own = ("_quality", "n_entities", "_entities", "_digest", "_row", "repeats", "score", "ids")
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *[f"'mine' as `{c}`" for c in own])
    found = stage(spark, docs, folder)
    rows = found.collect()
    if name == "pieces":
        assert sorted((r.doc_id or 0) for r in rows) == [0, 1, 1, 2, 3, 5] and all(r.text == (dict((d[0], d[1]) for d in ODD)[r.doc_id] or "") for r in rows)
    else:
        assert found.columns == docs.columns and all(r[c] == "mine" for r in rows for c in own)
    if name == "near_duplicates":
        assert sorted((r.doc_id or 0) for r in rows) == [0, 1, 2, 3, 5]
    if name == "personal_data":
        assert len(rows) == len(ODD) and [r.text for r in rows if r.doc_id is None][0] != ODD[4][1] and all(r.n_chars == len(r.text) for r in rows if r.text is not None)
    assert stage(spark, docs.limit(0), folder).count() == 0


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_same_rows_as_sql(spark, folder, name):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    got, want = queries.QUERIES[name](spark, folder).toPandas(), con.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
