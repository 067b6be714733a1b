"""Grounding of answers, kinds of answers, and what can be read off the steps of an agent's runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventgraph.functions import text as tx
from eventgraph.operators.ordering import settled

FIRST_DOCS, MOST_TIED, MOST_FOCUS = 5, 6, 20
#: Head nouns behind "which", "what" and "name", and the kind of answer that they ask for.
HEADS = {
    "venue": "venue", "venues": "venue", "stadium": "venue", "arena": "venue",
    "nation": "nation", "nations": "nation", "country": "nation", "countries": "nation", "noc": "nation",
    "athlete": "person", "athletes": "person", "person": "person", "competitor": "person", "medallist": "person",
    "date": "date", "dates": "date", "day": "date",
    "number": "number", "count": "number",
    "event": "event", "events": "event", "competition": "event", "discipline": "event",
}
#: Words that close such a phrase, and words that tell the kind themselves.
STOPS = tuple("at in of on for with from to by was were is are had has did does do held won took".split())
ASKING = {"who": "person", "whom": "person", "whose": "person", "where": "venue", "when": "date"}
#: Confidence by how a run stopped.
CONFIDENCE = {"verified": 0.98, "tied": 0.9, "candidates": 0.7, "synthesis": 0.5, "none": 0.3}
#: Parts of messages of a backend that is not there.
UNAVAILABLE = ("starting workspace", "connection timeout", "timed out", "http status 502", "http status 503", "http status 504", "bad gateway", "gateway timeout")


def evidence(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """(question_id, line): the first line of a cited document's first chunk that holds the folded value.

    wanted has question_id, doc_id, position and value; only the first documents of a question are read.
    """
    first = wanted.withColumn("_k", F.row_number().over(W.partitionBy("question_id").orderBy("position"))).where(F.col("_k") <= FIRST_DOCS)
    lead = chunks.where("chunk_index = 0").select("doc_id", F.posexplode(F.flatten(F.transform(F.split("text", "\n"), lambda line: F.split(line, " \\| ")))).alias("_at", "line"))
    hits = first.join(lead, "doc_id").where(F.contains(tx.fold(F.col("line")), tx.fold(F.col("value"))) & (tx.fold(F.col("value")) != ""))
    return hits.groupBy("question_id").agg(F.min_by("line", F.struct("_k", "_at")).alias("line"))


#: How a line of an infobox begins.
BOXED = "(?i)^\\s*(?:\\[infobox|[a-z_ ]{2,30}\\s*[:=])"


def prose(chunks: DataFrame) -> DataFrame:
    """The sentences of chunks outside infoboxes, with their place (_line, _at); other columns stay but the text."""
    kept = [c for c in chunks.columns if c != "text"]
    lines = chunks.select(*kept, F.posexplode(F.split("text", "\n")).alias("_line", "line")).where(~F.col("line").rlike(BOXED))
    return lines.select(*kept, "_line", F.posexplode(F.split("line", "(?<=[.!?])\\s+")).alias("_at", "sentence"))


def restated(chunks: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, sentence): the first sentence of a document's prose that matches a pattern."""
    found = prose(chunks.select("doc_id", "chunk_index", "text")).where(F.col("sentence").rlike(pattern))
    return found.groupBy("doc_id").agg(F.min_by("sentence", F.struct("chunk_index", "_line", "_at")).alias("sentence"))


def asked_kind(question: Column) -> Column:
    """The kind of answer that a question asks for; null where its wording does not say.

    The first word that can tell decides: "how many" and "count" a number, the words of ASKING by
    themselves, and behind "which", "what" or "name" the last head within six words and before a stop.
    """
    words = F.split(tx.fold(question), " ")
    asking, heads = (F.create_map(*[F.lit(x) for kv in d.items() for x in kv]) for d in (ASKING, HEADS))

    def told(word: Column, i: Column) -> Column:
        near = F.slice(words, i + 2, 6)
        stop = F.array_position(F.transform(near, lambda w: w.isin(*STOPS)), F.lit(True)).cast("int")
        open_ = F.when(stop > 0, F.slice(near, F.lit(1), stop - 1)).otherwise(near)
        head = F.get(F.reverse(F.filter(F.transform(open_, lambda w: F.try_element_at(heads, w)), lambda k: k.isNotNull())), F.lit(0))
        number = ((word == "how") & (F.get(words, i + 1) == "many")) | (word == "count")
        return F.when(number, "number").when(word.isin(*ASKING), F.try_element_at(asking, word)).when(word.isin("which", "what", "name"), F.coalesce(head, F.lit("")))

    return F.nullif(F.get(F.filter(F.transform(words, told), lambda k: k.isNotNull()), F.lit(0)), F.lit(""))


def grounded(answer: str, verified: str, passages: str, asks_year: str) -> Column:
    """Whether every part of an answer is supported.

    A part is the verified value, or a whole-number year where one is asked, or no mere number and
    found within a passage once letters and digits only are compared.
    """
    plain = lambda c: F.regexp_replace(F.lower(tx.ascii_fold(c)), "[^a-z0-9]+", "")
    parts = F.filter(F.transform(F.split(F.col(answer), ";"), lambda p: F.trim(p)), lambda p: p != "")

    def supported(part: Column) -> Column:
        digits = plain(part).rlike("^[0-9]*$")
        same = F.coalesce(plain(part) == plain(F.col(verified)), F.lit(False))
        year = F.col(asks_year) & part.rlike("^\\d{4}$") & F.exists(passages, lambda p: F.rlike(p, F.concat(F.lit("\\b"), part, F.lit("\\b"))))
        return same | year | (~digits & F.exists(passages, lambda p: F.contains(plain(p), plain(part))))

    return (F.size(parts) > 0) & F.forall(parts, supported)


def moved_years(question: Column, argument: Column) -> Column:
    """Years that an argument has and the question has not."""
    years = lambda t: F.regexp_extract_all(t, F.lit("\\b(1[89]\\d{2}|20\\d{2})\\b"), F.lit(1))
    return F.array_sort(F.array_except(years(argument), years(question)))


def reportable_tie(ambiguous: Column, candidates: Column, kind: Column, asked: Column) -> Column:
    return ambiguous & (F.size(candidates) <= MOST_TIED) & (asked.isNull() | kind.eqNullSafe(asked))


def is_hop(asked: Column, kind: Column) -> Column:
    """A verified value of another kind than the asked one is an intermediate result."""
    return asked.isNotNull() & kind.isNotNull() & (kind != asked)


def fan_out(tied: DataFrame, attributes: DataFrame) -> DataFrame:
    """(question_id, answer): distinct values of tied events in tie order, joined by semicolons.

    tied has question_id, event_id and position, attributes has event_id and value.
    """
    values = tied.join(attributes, "event_id").where("value is not null and value <> ''")
    first = values.groupBy("question_id", "value").agg(F.min("position").alias("at"))
    return first.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda v: v["value"]), "; ").alias("answer"))


def strategy_changes(steps: DataFrame) -> DataFrame:
    """Steps (run_id, step, tool, status) with whether the tool changed after a failed or ambiguous step."""
    order = W.partitionBy("run_id").orderBy("step")
    changed = F.lag("status").over(order).isin("failed", "ambiguous") & (F.lag("tool").over(order) != F.col("tool"))
    return steps.withColumn("changed", F.coalesce(changed, F.lit(False)))


def paired(events: DataFrame) -> DataFrame:
    """Each observation (run_id, step, kind, text) with the last plan before it."""
    order = W.partitionBy("run_id").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    plan = F.last(F.when(F.col("kind") == "plan", F.col("text")), ignorenulls=True).over(order)
    return events.withColumn("plan", plan).where("kind = 'observation'")


def confidence(path: Column) -> Column:
    return reduce(lambda rest, k: F.when(path == k, CONFIDENCE[k]).otherwise(rest), CONFIDENCE, F.lit(CONFIDENCE["none"]))


def unavailable(message: Column) -> Column:
    return F.coalesce(F.lower(message).rlike("|".join(UNAVAILABLE)), F.lit(False))


def intent(reply: Column) -> Column:
    """chat if a model's reply says so, else ask; no reply counts as ask."""
    return F.when(F.upper(F.trim(reply)).startswith("CHAT"), "chat").otherwise("ask")


def final_answer(answer: Column, is_grounded: Column, graph_value: Column) -> Column:
    """The graph's value in place of an answer without grounds."""
    return F.when(is_grounded | graph_value.isNull(), answer).otherwise(graph_value)


def side_by_side(lanes: dict[str, DataFrame]) -> DataFrame:
    """Results (qid, answer) of several pipelines in one row a question; a lane that failed is null."""
    named = [rows.select("qid", F.col("answer").alias(name)) for name, rows in lanes.items()]
    return reduce(lambda a, b: a.join(b, "qid", "full_outer"), named)


def focus_list(text: Column) -> Column:
    return F.slice(F.filter(F.transform(F.split(text, ","), lambda t: F.trim(t)), lambda t: t != ""), 1, MOST_FOCUS)


def cited(results: DataFrame) -> DataFrame:
    """(qid, doc_id, at): distinct cited documents in order of first appearance, answers that found nothing left out.

    results has qid, lane (order of the pipelines), answer and doc_ids.
    """
    given = results.where(~F.coalesce(tx.not_found(F.col("answer")), F.lit(True))).select("qid", "lane", F.posexplode("doc_ids").alias("_at", "doc_id"))
    first = given.groupBy("qid", "doc_id").agg(F.min(F.struct("lane", "_at")).alias("_f"))
    return first.select("qid", "doc_id", F.row_number().over(W.partitionBy("qid").orderBy("_f", "doc_id")).alias("at"))


def evidence_block(results: DataFrame) -> DataFrame:
    """Per pipeline: abstained, gold among the parts of the answer, grounded in the passages (numbers left out).

    results has pipeline, answer, gold and passages.
    """
    plain = lambda c: F.regexp_replace(F.lower(tx.ascii_fold(c)), "[^a-z0-9]+", "")
    parts = F.transform(F.split("answer", ";"), plain)
    no_number = ~plain(F.col("answer")).rlike("^[0-9]*$") & ~tx.not_found(F.col("answer"))
    supported = F.forall(F.filter(parts, lambda p: p != ""), lambda p: F.exists("passages", lambda t: F.contains(plain(t), p)))
    return results.groupBy("pipeline").agg(F.count_if(tx.not_found(F.col("answer"))).alias("abstained"), F.count_if(F.exists(parts, lambda p: p == plain(F.col("gold")))).alias("gold_among"), F.count_if(no_number & supported).alias("grounded"), F.count_if(no_number).alias("groundable"))


#: Fixed value: events that are read off one reply.
CANDIDATES = 10


def event_candidates(replies: DataFrame, key: str = "reply_id", reply: str = "reply") -> DataFrame:
    """(key, pos, name, competitor_count): the first CANDIDATES events within each JSON reply, however deep.

    An event is an object whose v_type is Event; its name and count are the attributes of which the part
    behind the last dot says so, a text that is not blank and a whole number. Replies are read as VARIANT,
    one level of all of them at a time; order is that of the paths, where an object's fields stand in order of their
    names. What is no JSON holds none. Keys tell replies apart.
    """
    spark, found = replies.sparkSession, None
    read = lambda v, path, kind: F.try_variant_get(v, path, kind)
    inner = lambda df, v: df.lateralJoin(spark.tvf.variant_explode(F.col(v).outer()))
    level = replies.select(key, F.array().cast("array<int>").alias("path"), F.try_parse_json(reply).alias("node"))
    while True:
        level = settled(level.where("node is not null"))
        if level.isEmpty():
            break
        events = level.where(F.lower(read(F.col("node"), "$.v_type", "string")) == "event").select(key, "path", read(F.col("node"), "$.attributes", "variant").alias("node"))
        found = events if found is None else found.unionByName(events)
        within = inner(level, "node").select(key, F.concat("path", F.array("pos")).alias("path"), F.col("value").alias("node"))
        level = within.where(F.schema_of_variant("node").rlike("^(OBJECT|ARRAY)"))
    if found is None:
        return replies.select(key, F.lit(0).alias("pos"), F.lit("").alias("name"), F.lit(0).cast("long").alias("competitor_count")).where(F.lit(False))
    fields = inner(found.where("node is not null"), "node").select(key, "path", "pos", F.lower(F.regexp_extract("key", "([^.]*)$", 1)).alias("field"), F.col("value").alias("v"))
    kind = F.schema_of_variant("v")
    name = F.when((F.col("field") == "name") & (kind == "STRING"), F.nullif(F.trim(read(F.col("v"), "$", "string")), F.lit("")))
    count = F.when((F.col("field") == "competitor_count") & (kind == "BIGINT"), read(F.col("v"), "$", "long"))
    first = lambda c, as_: F.min_by(c, F.when(c.isNotNull(), F.col("pos"))).alias(as_)
    named = fields.groupBy(key, "path").agg(first(name, "name"), first(count, "competitor_count")).where("name is not null")
    place = F.row_number().over(W.partitionBy(key).orderBy("path")) - 1
    return named.withColumn("pos", place).where(F.col("pos") < CANDIDATES).select(key, "pos", "name", "competitor_count")


#: Other names under which models give a tool's arguments.
ARGUMENT_NAMES = {
    "target_year": "year", "current_year": "year",
    "event_name": "event", "event_name_fragment": "event", "event_fragment": "event",
    "venue_name_fragment": "venue", "venue_fragment": "venue",
    "target_date_fragment": "date", "order_by": "order",
}


def _argument(name: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in ARGUMENT_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, name), name)


def tool_arguments(arguments: Column, known: tuple[str, ...], numbers: tuple[str, ...] = ("year", "threshold")) -> Column:
    """Arguments (a map of texts) under their proper names, the last of a name: empty ones and unknown names left out, numbers only if they are whole."""
    entries = F.transform(F.map_entries(arguments), lambda e: F.struct(_argument(e["key"]).alias("key"), F.trim(e["value"]).alias("value"), (e["value"] != "").alias("given")))
    good = F.filter(entries, lambda e: e["key"].isin(*known) & e["given"] & (~e["key"].isin(*numbers) | e["value"].rlike("^[+-]?[0-9]+$")))
    last = F.filter(good, lambda e, i: ~F.exists(F.slice(good, i + 2, F.size(good)), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"])))


def unsupported_arguments(arguments: Column, known: tuple[str, ...]) -> Column:
    """The names of given arguments that a tool does not have; they mostly mean that another tool was meant."""
    return F.map_keys(F.map_filter(arguments, lambda k, v: v.isNotNull() & ~v.isin("", "0") & ~_argument(k).isin(*known)))


def presets(questions: DataFrame) -> DataFrame:
    """Questions to choose from, without anything that gives their answers away."""
    return questions.select("qid", "question", "qtype")


def batch_rows(lanes: dict[str, DataFrame], chosen: list[str]) -> DataFrame:
    """(qid, pipeline, answer) of the chosen pipelines' results; an unknown name is an error."""
    if unknown := set(chosen) - set(lanes):
        raise ValueError(f"unknown pipelines: {sorted(unknown)}")
    return reduce(DataFrame.unionByName, [lanes[p].select("qid", F.lit(p).alias("pipeline"), "answer") for p in chosen])
