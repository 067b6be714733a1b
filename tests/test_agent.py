"""Literal questions, answers and run steps."""

import json

import pytest
from pyspark.sql import functions as F

from eventgraph.operators import agent


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


QUESTIONS = {
    "Which athlete won gold?": "person", "Who won?": "person", "How many nations took part?": "number", "In which stadium was it?": "venue", "When was it?": "date",
    "Which cross-country skiing event had most?": "event", "Name the country of the winner": "nation", "What was it?": None, "What year was the event held?": None,
    "Give the count of events": "number", "Where is it, and who won?": "venue", "Which of these athletes won?": None, "How long?": None,
}


@pytest.mark.parametrize(("question", "kind"), list(QUESTIONS.items()))
def test_asked_kind(spark, question, kind):
    assert value(spark, agent.asked_kind(F.lit(question))) == kind


@pytest.mark.parametrize(
    ("answer", "verified", "asks_year", "ok"),
    [("Ines Falk", None, False, True), ("40", "40", False, True), ("7", None, False, False), ("1998", None, True, True), ("1998", None, False, False), ("Ines Falk; Nobody", None, False, False), ("", None, False, False)],
)
def test_grounding(spark, answer, verified, asks_year, ok):
    rows = spark.createDataFrame([(answer, verified, ["In 1998 Inés Falk won with 7 points."], asks_year)], "a string, v string, p array<string>, y boolean")
    assert rows.select(agent.grounded("a", "v", "p", "y").alias("g")).first()["g"] is ok


def test_small_rules(spark):
    assert value(spark, agent.confidence(F.lit("tied"))) == 0.9 and value(spark, agent.confidence(F.lit("?"))) == 0.3
    assert value(spark, agent.is_hop(F.lit("person"), F.lit("event"))) and not value(spark, agent.is_hop(F.lit("person"), F.lit("person")))
    assert value(spark, agent.unavailable(F.lit("HTTP status 503: Starting workspace"))) and not value(spark, agent.unavailable(F.lit("connection refused")))
    assert value(spark, agent.intent(F.lit(" chat."))) == "chat" and value(spark, agent.intent(F.lit(None).cast("string"))) == "ask"
    assert value(spark, agent.focus_list(F.lit("a, ,b,"))) == ["a", "b"]
    assert value(spark, agent.final_answer(F.lit("x"), F.lit(False), F.lit("y"))) == "y"


def test_pairs_and_changes(spark):
    rows = spark.createDataFrame([(1, 1, "plan", "p1"), (1, 2, "observation", "o1"), (1, 3, "observation", "o2"), (1, 4, "plan", "p2"), (1, 5, "observation", "o3")], "run_id int, step int, kind string, text string")
    assert [(r.text, r.plan) for r in agent.paired(rows).orderBy("step").collect()] == [("o1", "p1"), ("o2", "p1"), ("o3", "p2")]
    steps = spark.createDataFrame([(1, 1, "count", "failed"), (1, 2, "rank", "ok"), (1, 3, "find", "ok")], "run_id int, step int, tool string, status string")
    assert [r.changed for r in agent.strategy_changes(steps).orderBy("step").collect()] == [False, True, False]


def test_evidence(spark):
    results = spark.createDataFrame([("p", "Ada; Bo", "bo", ["Ada and Bo won"]), ("p", "Not found in corpus.", "x", ["t"]), ("p", "12", "12", ["12 won"])], "pipeline string, answer string, gold string, passages array<string>")
    r = agent.evidence_block(results).first()
    assert (r.abstained, r.gold_among, r.grounded, r.groundable) == (1, 2, 1, 1)
    chunks = spark.createDataFrame([(1, 0, "venue: Hall | gold: Ada Berg\nAda Berg won twice. It was cold.")], "doc_id int, chunk_index int, text string")
    wanted = spark.createDataFrame([(9, 1, 1, "ADA BERG")], "question_id int, doc_id int, position int, value string")
    assert agent.evidence(chunks, wanted).first()["line"] == "gold: Ada Berg"
    assert agent.restated(chunks, "won twice").first()["sentence"] == "Ada Berg won twice."


def test_events_within_replies(spark):
    """Any depth, dotted field names, the first of several, ten at most; what is no JSON holds none."""
    event = lambda name, **more: {"v_type": "Event", "attributes": {"Events.name": name} | more}
    replies = [
        (1, json.dumps({"results": [{"Events": [event("a", competitor_count=3), event(" b ", **{"x.competitor_count": 4})]}, [[event("c", competitor_count="5")]]]})),
        (2, json.dumps([event(f"n{i:02}") for i in range(15)])),
        (3, "no json"), (4, None), (5, json.dumps({"v_type": "Event", "attributes": {"name": "  "}})), (6, "7"),
        (7, json.dumps({"v_type": "EVENT", "attributes": {"a.name": 1, "b.name": "in", "sub": event("deep", competitor_count=True)}})),
        (8, json.dumps({"v_type": "Event", "attributes": None})), (9, json.dumps({"v_type": "Venue", "attributes": {"name": "x"}})),
    ]
    got = [tuple(r) for r in agent.event_candidates(spark.createDataFrame(replies, "reply_id long, reply string")).orderBy("reply_id", "pos").collect()]
    assert got == [(1, 0, "a", 3), (1, 1, "b", 4), (1, 2, "c", None), *((2, i, f"n{i:02}", None) for i in range(10)), (7, 0, "in", None), (7, 1, "deep", None)]
    assert agent.event_candidates(spark.createDataFrame([], "reply_id long, reply string")).count() == 0
