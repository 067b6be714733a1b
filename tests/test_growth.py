"""Rows that are alike are worked on once: what a step handles does not grow with their copies."""

import pytest
from pyspark.sql import functions as F

from eventgraph.operators import linking, toolkit

ASKED = "question_id long, phrase string, sport string, year int, season string, gender string"
EVENTS = "event_id long, name string, sport string, year int, season string, gender string"


def repeated(spark, copies):
    kinds = [(f"Luge at the {y} Winter Olympics – Women’s run {n}", "Luge", y, "Winter", "Women") for y in (1994, 1998) for n in (1, 2)]
    events = spark.createDataFrame([(1000 * c + i, *k) for c in range(copies) for i, k in enumerate(kinds)], EVENTS)
    forms = [("women’s run 1", "Luge", 1994, None, None), ("run 2", None, None, None, None), (None, "Luge", 1998, None, None), (None, None, None, None, None)]
    return spark.createDataFrame([(100 * c + i, *f) for c in range(copies) for i, f in enumerate(forms)], ASKED), events


@pytest.fixture
def sides(monkeypatch):
    seen, pairs = [], linking.setjoin.similar_pairs
    monkeypatch.setattr(linking.setjoin, "similar_pairs", lambda left, right, least: seen.append((left.count(), right.count())) or pairs(left, right, least))
    return seen


def test_links_of_equal_questions_and_titles(spark, sides):
    questions, events = repeated(spark, 30)
    got = {}
    for r in linking.link_events(questions.where("phrase is not null"), events).collect():
        got.setdefault(r.question_id, []).append((r["rank"], r.event_id, r.score))
    assert sides == [(2, 4)]  # two wordings, four titles
    assert len(got) == 60
    for question, found in got.items():
        first = [1000 * c for c in range(10)] if question % 100 == 0 else [1000 * c + 1 for c in range(10)]
        assert [e for _, e, _ in sorted(found)] == first and [r for r, _, _ in sorted(found)] == list(range(1, 11))


def test_listing_of_equal_constraints(spark, sides):
    questions, events = repeated(spark, 30)
    got = {r.question_id: (r.total, r.event_ids) for r in toolkit.find_events(questions, events).collect()}
    assert sides == [(2, 4)] and len(got) == 120
    held = sorted(1000 * c + i for c in range(30) for i in (2, 3))
    every = sorted(1000 * c + i for c in range(30) for i in range(4))
    for question, (total, ids) in got.items():
        if question % 100 == 2:
            assert (total, list(ids)) == (60, held[:25])
        elif question % 100 == 3:
            assert (total, list(ids)) == (120, every[:25])


def test_articles_are_read_once_for_all_edges(spark, folder):
    from eventgraph.plans import registry

    for name in ("corpus_edges", "corpus_totals"):
        plan = registry.QUERIES[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
        assert "Infobox" not in plan and "documents.parquet" not in plan


def test_beginnings_say_what_whole_texts_say(spark, monkeypatch):
    from eventgraph.operators import ingest

    box = "[Infobox Olympic event]\n event: Luge\n gold: Ann\n"
    texts = [box, box + "\nThere were 3", box + "\r\n\r\nx\r\n\r\ny", "a\n" * 30 + box + " \nopening\nmore\n\nrest", box + "\n" + "o" * 90 + "\n\nrest", box + "\n\n\nz\n\n", "", "no box\n\nat all", "x" * 20 + "\n" + box.upper() + "\t\nend\n\n\n", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    read = lambda: {r.i: (r.b.box, r.b.opening) for r in rows.select("i", ingest.box_and_opening(F.col("text")).alias("b")).collect() if r.b}
    monkeypatch.setattr(ingest, "HEADS", ())
    whole = read()
    assert whole[3] == ({"event": "Luge", "gold": "Ann"}, "opening\nmore")
    for heads in ((7,), (40, 60), tuple(range(1, 9)), (65, 130)):
        monkeypatch.setattr(ingest, "HEADS", heads)
        assert read() == whole


def test_templated_questions_of_one_form(spark, monkeypatch):
    rows = [(i, f"Luge at the 1998 Winter Olympics – Run {i % 3}", f"Run {i % 3}", "Luge", 1998, "Winter", "Park", "8 May", f"Ann {i}", 1 + i % 2, 2) for i in range(12)]
    events = spark.createDataFrame(rows, "event_id long, name string, label string, sport string, year int, season string, venue string, start_date string, gold_athlete string, competitor_count int, nation_count int")
    texts = ["how many Luge events at the 1998 Winter Olympics had more than 1 competitors?", "which Luge event at the 1998 Winter Olympics had the highest number?", "Who won the event held at Park on 8 May?", "How many nations competed in Luge at the 1998 Winter Olympics – Run 1?"]
    questions = spark.createDataFrame([(100 * c + i, t) for c in range(20) for i, t in enumerate(texts)], "question_id long, question string")
    forms = toolkit.classed_answers(questions, events)
    assert forms["asked"].select("form").distinct().count() == 4 and forms["answers"].count() == 1 + 6 + 12 + 4
    assert toolkit.template_answers(questions, events).count() == 20 * 23
    assert {(r.question_id % 100, r.answer) for r in toolkit.single_answers(questions, events).collect()} == {(0, "6")}


def test_a_venue_and_date_is_looked_up_once(spark):
    events = spark.createDataFrame([(i, f"Run {i}", "Park", "8 May", 1998 + i % 2, f"Ann {i}") for i in range(10)] + [(99, "Run", "Park", "9 May", 1998, "Eve")], "event_id long, name string, venue string, start_date string, year int, gold_athlete string")
    asked = spark.createDataFrame([(i, "Park", ("8 May", "9 May", "8 May 1999")[i % 3]) for i in range(60)], "question_id long, venue string, date string")
    forms, met = linking.places_met(asked, events)
    assert forms.count() == 3 and met.count() == 10 + 1 + 5
    got = {r.question_id: (r.status, r.candidates) for r in toolkit.attributes_at_venue(asked, events, "gold_athlete", F.size).collect()}
    assert got == {i: (("ambiguous", 10), ("conclusive", 1), ("ambiguous", 5))[i % 3] for i in range(60)}
    assert linking.at_venue_date(asked, events).count() == 20 * 16


def test_golds_are_counted_and_not_listed(spark, folder):
    from eventgraph.operators import metrics
    from eventgraph.plans import registry

    metric_queries = registry.metric_queries
    ranked, gold, sizes = metric_queries.rankings(spark, folder)
    labels, left = metric_queries.labelled(spark, folder)
    every = left.join(labels, "label").where("query_id <> vec_id").select("query_id", F.col("vec_id").alias("id"))
    assert gold.count() <= ranked.count() < every.count()
    whole = metrics.cutoffs(ranked, every, (1, 5, 10)).first()
    assert metrics.cutoffs(ranked, gold, (1, 5, 10), sizes).first() == whole


def test_names_within_phrases_meet_once_a_set_of_words(spark, monkeypatch):
    phrases = spark.createDataFrame([(i, ("the big red ball of men", "Red, big ball", "none")[i % 3]) for i in range(60)], "phrase_id long, phrase string")
    names = spark.createDataFrame([("big",), ("ball red",), ("Red ball",), ("big blue ball",), ("of",), ("",)], "name string")
    sizes, settled = [], linking.settled
    monkeypatch.setattr(linking, "settled", lambda rows: sizes.append(rows.count()) or settled(rows))
    got = {r.phrase_id: r.name for r in linking.longest_within(phrases, names).collect()}
    assert got == {i: "ball red" for i in range(60) if i % 3 < 2}
    assert sizes == [3, 3, 4]  # wordings, their sets of words, the names'


def test_rankings_are_made_once(spark, folder):
    from eventgraph.plans import registry

    plan = lambda name: registry.QUERIES[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan("context_recall")  # the ranking is read from where it was written
    for name in ("hybrid_stages", "hybrid_rescored"):
        assert "MapInArrow" not in plan(name)  # nor are vectors compared again for each stage


def test_bodies_are_cut_once_for_all_documents_that_end_with_them(spark):
    import random

    from eventgraph.operators import ingest

    rng = random.Random(4)
    line = lambda: rng.choice("ab é") * rng.choice((0, 1, 3, 8, 20, 45, 90)) + rng.choice(("", "x", " y "))
    text = lambda most: rng.choice(("\n\n", "\n\n\n")).join(line() for _ in range(rng.randrange(most + 1)))
    texts = [text(12) for _ in range(60)] + ["", " \n", "\n\nz", "one", None, "\n".join("abc")]
    heads = [text(4) + "\n\n" for _ in range(60)] + ["", "\n\n", "w" * 300 + "\n\n", "w" * 300 + "\n\nv\n\n", "v\n\n" + "w" * 300 + "\n\n"]
    pairs = [(f"{i}/{k}", k if k < len(texts) else None, h) for i, h in enumerate(heads) for k in range(len(texts) + 1)] + [("null", 0, None)]
    docs = spark.createDataFrame([(d, f"t{d}", f"Title: t{d} | x", h, k) for d, k, h in pairs], "doc_id string, title string, header string, text string, key int")
    rows = spark.createDataFrame(list(enumerate(texts)), "key int, text string")
    joined = docs.join(rows.withColumnRenamed("text", "rest"), "key", "left").withColumn("text", F.concat("text", F.coalesce("rest", F.lit(""))))
    for limit in (1, 5, 13, 30, 400):
        want = sorted(map(tuple, ingest.chunks(joined, limit=limit).collect()), key=repr)
        cut = ingest.named_chunks(ingest.chunks_behind(docs.join(ingest.bodies(rows, limit=limit), "key", "left"), limit=limit))
        got = sorted(map(tuple, cut.select("doc_id", "chunk_index", "chunk_id", "prev_chunk_id", "next_chunk_id", "text", "raw_text").collect()), key=repr)
        assert got == want and len({d for d, *_ in got}) == len(pairs)


def test_ways_through_a_body_stay_few():
    import numpy as np

    from eventgraph.operators import ingest

    for size, n in ((1, 200_000), (3, 50_000), (150, 5_000), (900, 2_000)):
        sums, ways = ingest.cuts(np.full(n, size))
        assert len(sums) == 400 // size and len(ways) == max(1, len(sums)) + 1
        assert sum(map(len, ways)) <= 2 * size * n + 400


def test_articles_are_packed_from_their_beginnings(spark, folder):
    """The documents' texts are parted below their join with the events, and packing is in the plan once."""
    from eventgraph.plans import registry

    plan = registry.QUERIES["corpus_chunks"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Join LeftOuter, (doc_id", 1) if "Join LeftOuter, (doc_id" in plan else plan.split("Join LeftOuter", 1)
    assert plan.count("aggregate(filter(transform(split(") == 1 and "replace(coalesce(text" in below and "replace(coalesce(text" not in above
    assert registry.QUERIES["chunk_documents"](spark, folder)._jdf.queryExecution().optimizedPlan().toString().count("aggregate(filter(transform(split(") == 1


def test_articles_that_are_alike_are_one_row(spark, folder, monkeypatch):
    from eventgraph.operators import ingest
    from eventgraph.plans import corpus_queries, proxy

    events, twice = proxy.events, lambda *a: events(*a).unionByName(events(*a).withColumn("event_id", F.col("event_id") + 440_000))  # the same remainders
    run = lambda: sorted(tuple(r) for r in corpus_queries.corpus_chunks(spark, folder).where("doc_id < 440000").collect())
    once, n = run(), proxy.alike_articles(spark, folder).count()
    monkeypatch.setattr(proxy, "events", twice)
    assert proxy.alike_articles(spark, folder).count() == n and run() == once
    assert corpus_queries.corpus_chunks(spark, folder).count() == 2 * len(once)
    monkeypatch.setattr(proxy, "ALIKE", 400_000)  # ranges part them: no list grows without bound
    assert proxy.alike_articles(spark, folder).count() == 2 * n and run() == once
