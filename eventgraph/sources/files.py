"""JSON lines, JSON and CSV in and out, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from eventgraph.sources.snapshots import Snapshots

CORPUS = "doc_id string, wikidata_qid string, wikipedia_pageid int, title string, url string, text string, approx_tokens int"
QUESTIONS = "qid string, question string, qtype string, answer string, gold_doc_ids array<string>, source_qid string"
EMBEDDINGS = "chunk_id string, embedding array<double>, model string, dimension int, task string, text_sha256 string"


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """Corpus rows; a line that is not of the schema is an error, blank lines are skipped."""
    return spark.read.schema(CORPUS).option("mode", "FAILFAST").json(path)


#: Where a line stands: its file, its part of the file, and its place in that part.
PLACE = ("file", "part", "line")


def _place():
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("line"))


def questions(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Questions; with a limit the first of the files in order of name and line."""
    rows = spark.read.schema(QUESTIONS).option("mode", "FAILFAST").json(path)
    if not limit:
        return rows
    return rows.select("*", _place().alias("_place")).orderBy("_place").limit(limit).drop("_place")


def results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def corpus_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The same rows as files arrive in a folder."""
    return spark.readStream.schema(CORPUS).json(folder)


def embedding_cache(spark: SparkSession, path: str) -> DataFrame:
    """Cache rows with the place of their lines, which orders them; bad lines are left out."""
    lines = spark.read.text(path).select("value", _place().alias("line_no"))
    return lines.select(F.from_json("value", EMBEDDINGS, {"mode": "PERMISSIVE"}).alias("r"), "line_no").where("r.chunk_id is not null").select("r.*", "line_no")


def valid_embeddings(cache: DataFrame, chunks: DataFrame, model: str, size: int, task: str) -> DataFrame:
    """(chunk_id, embedding): the last valid cache row of each known chunk.

    A row is valid if model, size, task and the hash of the chunk's present text agree and the vector
    is finite and not all zero.
    """
    from eventgraph.operators.retrieval import valid_vector

    known = chunks.select("chunk_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
    good = cache.where((F.col("model") == model) & (F.col("dimension") == size) & (F.col("task") == task) & valid_vector("embedding", size))
    return good.join(known, ["chunk_id", "text_sha256"]).groupBy("chunk_id").agg(F.max_by("embedding", "line_no").alias("embedding"))


def query_key(model: str, size: int, text: str = "text"):
    """Key of a query vector: a hash of model, size, purpose and text."""
    return F.sha2(F.concat_ws("|", F.lit(model), F.lit(str(size)), F.lit("search_query"), F.col(text)).cast("binary"), 256)


def missing_queries(queries: DataFrame, cache: DataFrame, model: str, size: int) -> DataFrame:
    """Queries (text and others) whose vector is not in a cache (key) yet, each text once."""
    keyed = queries.withColumn("key", query_key(model, size)).dropDuplicates(["key"])
    return keyed.join(cache.select("key"), "key", "left_anti")


def request_key(*parts: str):
    """Key of a whole request: a hash of all its columns as JSON, so that any change is another request."""
    return F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).cast("binary"), 256)


def answered(spark: SparkSession, requests: DataFrame, path: str, parts: tuple[str, ...]) -> DataFrame:
    """requests with the reply that a cache of JSON lines (key, reply) has for each, the last of a key, else null; a malformed line is an error."""
    lines = spark.read.schema("key string, reply string").option("mode", "FAILFAST").json(path).withColumn("_at", _place())
    cache = lines.groupBy("key").agg(F.max_by("reply", "_at").alias("reply"))
    return requests.withColumn("key", request_key(*parts)).join(cache.select("key", "reply"), "key", "left")


def append_embeddings(rows: DataFrame, path: str, size: int) -> None:
    """Append cache rows, all or none: a bad vector is an error before anything is written."""
    from eventgraph.operators.retrieval import valid_vector

    bad = rows.where(~F.coalesce(valid_vector("embedding", size), F.lit(False))).count()
    if bad:
        raise ValueError(f"{bad} vectors are not valid")
    rows.write.mode("append").json(path)


def export(rows: DataFrame, nested: str, flat: str, lists: tuple[str, ...] = ()) -> None:
    """Nested JSON, and CSV with list columns joined by a semicolon."""
    rows.write.mode("overwrite").json(nested)
    joined = rows.select(*[F.concat_ws(";", c).alias(c) if c in lists else F.col(c) for c in rows.columns])
    joined.write.mode("overwrite").option("header", True).csv(flat)


def append_results(rows: DataFrame, path: str, spark: SparkSession, schema: str, key: str = "qid") -> None:
    """Append the results that are not there yet, so that a run can be resumed."""
    try:
        there = spark.read.schema(schema).json(path).select(key)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        there = rows.select(key).limit(0)
    rows.join(there, key, "left_anti").write.mode("append").json(path)


def write_counted(rows: DataFrame, path: str, expected: int | None = None) -> int:
    """Write rows as Parquet and compare what is there afterwards with what was sent; a difference is an error.

    What is sent is counted as it is written, what is there by the files' footers: the rows are made once. Spark repeats
    failed tasks itself, so there is no loop of tries.
    """
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    sent = seen.get["n"] if expected is None else expected
    there = rows.sparkSession.read.schema(rows.schema).parquet(path).count()
    if there != sent:
        raise ValueError(f"{there} of {sent} rows were accepted")
    return there


def planned(tables: dict[str, DataFrame]) -> dict[str, int]:
    """Dry run: how many rows each table would get; everything is computed, nothing written."""
    return {name: rows.count() for name, rows in tables.items()}


def commit_embeddings(rows: DataFrame, store: Snapshots, size: int, table: str = "embeddings") -> int:
    """Append cache rows in one commit, all or none: a bad vector fails the write before any row is visible."""
    from eventgraph.operators.retrieval import valid_vector

    sound = F.coalesce(valid_vector("embedding", size), F.lit(False))
    checked = rows.withColumn("embedding", F.when(sound, F.col("embedding")).otherwise(F.raise_error(F.lit("a vector is not valid")).cast(rows.schema["embedding"].dataType)))
    return store.commit(append={table: checked})


def commit_results(rows: DataFrame, store: Snapshots, told: DataFrame, key: str = "qid") -> int:
    """Append the results that are not there yet and the manifest of their run, in one commit."""
    new = rows.join(store.read("results").select(key), key, "left_anti")
    return store.commit(append={"results": new.select(*store.read("results").columns), "manifests": told})


def manifest(questions_: DataFrame, settings: dict[str, str]) -> DataFrame:
    """One row about a run: how many questions, a hash of them that does not depend on their order, and the settings."""
    digest = F.sum(F.xxhash64(*questions_.columns).cast("decimal(38,0)")).cast("string")
    told = F.to_json(F.create_map(*[F.lit(x) for kv in sorted(settings.items()) for x in kv])) if settings else F.lit("{}")
    return questions_.agg(F.count(F.lit(1)).alias("n_questions"), F.coalesce(digest, F.lit("0")).alias("questions_hash"), told.alias("settings"))


def create_tables(spark: SparkSession, schemas: dict[str, str]) -> None:
    """Create what is not there of the tables, and add the columns that existing ones lack; nothing is dropped or changed."""
    for name, columns in schemas.items():
        spark.sql(f"create table if not exists {name} ({columns}) using parquet")
        have = {c.lower() for c in spark.table(name).columns}
        new = [f"{c.name} {c.dataType.simpleString()}" for c in spark.createDataFrame([], columns).schema if c.name.lower() not in have]
        if new:
            spark.sql(f"alter table {name} add columns ({', '.join(new)})")


def missing_tables(spark: SparkSession, required: dict[str, str]) -> dict[str, list[str]]:
    """Of the required tables those that are not there (no columns named), and the columns that others lack."""
    there = {t.name.lower() for t in spark.catalog.listTables()}
    out: dict[str, list[str]] = {}
    for name, columns in required.items():
        if name.lower() not in there:
            out[name] = []
        elif lacking := {c.name.lower() for c in spark.createDataFrame([], columns).schema} - {c.lower() for c in spark.table(name).columns}:
            out[name] = sorted(lacking)
    return out


def markdown(rows: DataFrame, most: int = 200) -> str:
    """A small report table in the order of its rows; more rows than that are an error, not cut."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows are no report")
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in found)]) + "\n"
