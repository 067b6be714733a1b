"""JSON lines in and out: bad lines, validation, resume."""

import json

import pytest

from eventgraph.session import shared_folder
from eventgraph.sources import files
from eventgraph.sources.snapshots import Snapshots
from eventgraph.streaming import ingestion


def test_cache_keeps_the_last_valid_row(spark, tmp_path):
    import hashlib

    sha = hashlib.sha256(b"text").hexdigest()
    row = lambda v, **k: json.dumps({"chunk_id": "c1", "embedding": v, "model": "m", "dimension": 2, "task": "doc", "text_sha256": sha} | k)
    lines = [row([1.0, 0.0]), "{broken", row([0.0, 2.0]), row([0.0, 0.0]), row([9.0, 9.0], model="other"), row([5.0, 5.0], text_sha256="x"), row([1.0])]
    (tmp_path / "cache.jsonl").write_text("\n".join(lines))
    chunks = spark.createDataFrame([("c1", "text")], "chunk_id string, text string")
    got = files.valid_embeddings(files.embedding_cache(spark, f"file://{tmp_path}/cache.jsonl"), chunks, "m", 2, "doc").collect()
    assert [(r.chunk_id, r.embedding) for r in got] == [("c1", [0.0, 2.0])]


def test_append_is_all_or_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [0.0, 0.0])], "chunk_id string, embedding array<double>")
    with pytest.raises(ValueError, match="1 vectors"):
        files.append_embeddings(rows, f"{tmp_path}/out", 2)
    assert not (tmp_path / "out").exists()


def test_resume(spark, tmp_path):
    schema = "qid string, answer string"
    rows = spark.createDataFrame([("q1", "a"), ("q2", "b")], schema)
    for _ in range(2):
        files.append_results(rows, f"file://{tmp_path}/runs", spark, schema)
    assert spark.read.schema(schema).json(f"file://{tmp_path}/runs").count() == 2


def test_corpus_fails_on_bad_rows(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"doc_id": "d", "title": "t", "text": "x"}\n\n{"doc_id": "e"')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.corpus(spark, f"file://{tmp_path}/c.jsonl").collect()


def test_export(spark, tmp_path):
    rows = spark.createDataFrame([("q1", ["a", "b"])], "qid string, ids array<string>")
    files.export(rows, f"file://{tmp_path}/j", f"file://{tmp_path}/c", ("ids",))
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/c").first()["ids"] == "a;b"
    assert files.markdown(rows.select("qid")) == "| qid |\n|---|\n| q1 |\n"
    with pytest.raises(ValueError, match="more than 0"):
        files.markdown(rows.select("qid"), 0)


def test_first_questions_of_the_files(spark, tmp_path):
    for name, first in (("b", 3), ("a", 0)):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"qid": f"q{first + i}", "question": "?"}) + "\n" for i in range(3)))
    assert [r.qid for r in files.questions(spark, f"file://{tmp_path}", 4).collect()] == ["q0", "q1", "q2", "q3"]
    assert files.questions(spark, f"file://{tmp_path}").count() == 6


def test_last_row_wins_over_files(spark, tmp_path):
    row = lambda v: json.dumps({"chunk_id": "c1", "embedding": v, "model": "m", "dimension": 1, "task": "d", "text_sha256": "x"})
    (tmp_path / "2.jsonl").write_text(row([2.0]) + "\n" + row([3.0]))
    (tmp_path / "1.jsonl").write_text(row([1.0]))
    rows = files.embedding_cache(spark, f"file://{tmp_path}").orderBy("line_no").collect()
    assert [r.embedding for r in rows] == [[1.0], [2.0], [3.0]]


def test_response_cache(spark, tmp_path):
    requests = spark.createDataFrame([("m", "hello", 0), ("m", "other", 0)], "model string, prompt string, temperature int")
    parts = ("model", "prompt", "temperature")
    key = requests.select(files.request_key(*parts).alias("k")).first()["k"]
    (tmp_path / "c.jsonl").write_text(json.dumps({"key": key, "reply": "hi"}) + "\n")
    assert {r.prompt: r.reply for r in files.answered(spark, requests, f"file://{tmp_path}/c.jsonl", parts).collect()} == {"hello": "hi", "other": None}
    (tmp_path / "c.jsonl").write_text("".join(json.dumps({"key": key, "reply": r}) + "\n" for r in ("old", "newer", "newest")))
    assert files.answered(spark, requests, f"file://{tmp_path}/c.jsonl", parts).where("prompt = 'hello'").first()["reply"] == "newest"
    (tmp_path / "c.jsonl").write_text('{"key": ')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.answered(spark, requests, f"file://{tmp_path}/c.jsonl", parts).collect()


def test_accepted_counts(spark, tmp_path):
    rows = spark.range(5)
    assert files.write_counted(rows, f"file://{tmp_path}/out") == 5
    with pytest.raises(ValueError, match="5 of 6"):
        files.write_counted(rows, f"file://{tmp_path}/out", 6)


def test_manifest_ignores_order(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "qid string, question string")
    one, other = (files.manifest(r, {"k": "1"}).first() for r in (rows, rows.orderBy("qid", ascending=False)))
    assert one == other and one.n_questions == 2 and one.questions_hash != files.manifest(rows.limit(1), {}).first().questions_hash


def test_tables_are_created_and_checked(spark):
    schemas = {"vertex_a": "id string, n int", "edge_b": "src string"}
    assert files.missing_tables(spark, schemas) == {"vertex_a": [], "edge_b": []}
    try:
        files.create_tables(spark, schemas)
        assert files.missing_tables(spark, schemas | {"vertex_a": "id string, n int, valid_from timestamp"}) == {"vertex_a": ["valid_from"]}
        files.create_tables(spark, {"vertex_a": "id string, n int, valid_from timestamp"})
        assert spark.table("vertex_a").columns == ["id", "n", "valid_from"]
    finally:
        for name in schemas:
            spark.sql(f"drop table if exists {name}")


def test_one_pass_counts_and_writes(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def counted(rows):
        for row in rows:
            made.add(1)
            yield row

    rows = spark.createDataFrame(spark.range(50).rdd.mapPartitions(counted), "id long")
    assert files.write_counted(rows, f"file://{tmp_path}/once") == 50 and made.value == 50
    assert files.planned({"a": spark.range(3), "b": spark.range(0)}) == {"a": 3, "b": 0}


def test_embeddings_and_results_in_one_commit(spark):
    store = Snapshots(spark, shared_folder(spark, "store"), {"embeddings": "chunk_id string, embedding array<double>", "results": "qid long, answer string", "manifests": "n long"})
    rows = lambda *r: spark.createDataFrame(list(r), store.schemas["embeddings"])
    files.commit_embeddings(rows(("a", [1.0, 2.0])), store, 2)
    with pytest.raises(Exception, match="not valid"):
        files.commit_embeddings(rows(("b", [1.0, 2.0]), ("c", [0.0, 0.0])), store, 2)
    assert [r.chunk_id for r in store.read("embeddings").collect()] == ["a"]
    told = spark.createDataFrame([(2,)], "n long")
    result = lambda *q: spark.createDataFrame([(i, f"a{i}") for i in q], store.schemas["results"])
    files.commit_results(result(1, 2), store, told)
    files.commit_results(result(2, 3), store, told)
    assert sorted(r.qid for r in store.read("results").collect()) == [1, 2, 3] and store.read("manifests").count() == 2
    assert store.latest()["counts"] == {"results": 1, "manifests": 1}


@pytest.mark.parametrize("when", ["before", "after"])
def test_a_stopped_stream_goes_on(spark, tmp_path, when):
    """Stopped before or after the commit of its second batch, and started again, a stream gives what one batch gives."""
    for k in range(3):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.jsonl").write_text("".join(json.dumps({"doc_id": f"d{k}{i}", "title": f"T{i}", "text": "one\n\ntwo" * i or None}) + "\n" for i in range(4)))
    store = Snapshots(spark, shared_folder(spark, "chunks"), ingestion.SCHEMAS)
    stream = lambda: spark.readStream.schema(files.CORPUS).option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in")
    sink = ingestion.once(store, "chunks", ingestion.to_chunks)

    def stopped(batch, number):
        if number == 1 and when == "before":
            raise RuntimeError("stopped")
        sink(batch, number)
        if number == 1:
            raise RuntimeError("stopped")

    first = ingestion.run(stream(), store, f"file://{tmp_path}/cp", stopped)
    with pytest.raises(Exception, match="stopped"):
        first.awaitTermination(120)
    assert store.read("manifests").count() == (1 if when == "before" else 2)
    assert ingestion.run(stream(), store, f"file://{tmp_path}/cp").awaitTermination(120)
    want = ingestion.to_chunks(files.corpus(spark, f"file://{tmp_path}/in"))
    assert sorted(map(tuple, store.read("chunks").collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert sorted((r.batch, r.n_documents) for r in store.read("manifests").collect()) == [(0, 4), (1, 4), (2, 4)]
