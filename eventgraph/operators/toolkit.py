"""Typed composite questions over events: counting, ranking, previous editions, vocabulary checks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventgraph.operators import agent, graph, linking
from eventgraph.operators.ordering import settled

#: Comparison words and the inclusive bounds that each means for a threshold t.
#: Forms that are bounded above begin at 1, because 0 is an unknown count.
COMPARISONS = {
    "more_than": lambda t: (t + 1, None),
    "at_least": lambda t: (t, None),
    "fewer_than": lambda t: (1, t - 1),
    "at_most": lambda t: (1, t),
    "exactly": lambda t: (t, t),
}


def bounds(comparison: str, threshold: int) -> tuple[int, int | None]:
    """Inclusive bounds of a comparison word; the upper one is None where there is none."""
    if comparison not in COMPARISONS:
        raise ValueError(f"unknown comparison {comparison!r}; known: {sorted(COMPARISONS)}")
    return COMPARISONS[comparison](threshold)


def within(count: Column, comparison: str, threshold: int) -> Column:
    """Whether a count is within the bounds of a comparison word; an empty range holds nothing."""
    least, most = bounds(comparison, threshold)
    if most is not None and most < least:
        return F.lit(False)
    return (count >= least) if most is None else count.between(least, most)


def count_events(events: DataFrame, comparison: str, threshold: int, sport: str = "", year: int = 0, season: str = "", gender: str = "") -> DataFrame:
    """How many events are within a bound, and the first names of them."""
    texts = (("sport", sport), ("season", season), ("gender", gender))
    conditions = [within(F.col("competitor_count"), comparison, threshold)] + [graph.same_text(c, v) for c, v in texts if v] + ([F.col("year") == year] if year else [])
    found = graph.only(events, conditions)
    return found.agg(F.count(F.lit(1)).alias("match_count")).crossJoin(F.broadcast(graph.listed(found)))


def count_by_group(events: DataFrame, thresholds: list[tuple[str, int]]) -> DataFrame:
    """The same counts for every sport and year and several bounds, in one pass."""
    counts = [F.count_if(within(F.col("competitor_count"), c, t)).alias(f"{c}_{t}") for c, t in thresholds]
    return events.groupBy("sport", "year").agg(*counts)


def rank_events(events: DataFrame, keys: list[str], descending: bool = True) -> DataFrame:
    """The events at the extreme of each group, unknown counts left out, with the number that tie."""
    order = F.col("competitor_count").desc() if descending else F.col("competitor_count").asc()
    ranked = events.where("competitor_count > 0").withColumn("_rank", F.rank().over(W.partitionBy(*keys).orderBy(order))).where("_rank = 1")
    return ranked.withColumn("n_tied", F.count(F.lit(1)).over(W.partitionBy(*keys))).drop("_rank")


def previous_year(events: DataFrame) -> DataFrame:
    """(season, year, previous_year): the last year before it with an event of the season, else null."""
    years = events.where("year > 0").select("season", "year").distinct()
    return years.withColumn("previous_year", F.lag("year").over(W.partitionBy("season").orderBy("year")))


def previous_edition(events: DataFrame, precedes: DataFrame) -> DataFrame:
    """(event_id, prior_event, winner, skipped): the prior edition, and whether it skips a year of the season."""
    prior = events.select(F.col("event_id").alias("dst"), F.col("name").alias("prior_event"), F.col("gold_athlete").alias("winner"), F.col("year").alias("prior_year"))
    single = precedes.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("src"))).where("_n = 1").select("src", "dst")
    found = events.join(single, events.event_id == single.src).join(prior, "dst")
    return found.join(previous_year(events), ["season", "year"], "left").select("event_id", "prior_event", "winner", (F.coalesce(F.col("prior_year") < F.col("previous_year"), F.lit(False))).alias("skipped"))


def unmatched(wanted: DataFrame, events: DataFrame, columns: list[str]) -> DataFrame:
    """Constraints (constraint_name, constraint_value) that match no event, so that 0 is not mistaken for an answer."""
    known = [events.select(F.lit(c).alias("constraint_name"), F.lower(F.col(c).cast("string")).alias("_value")).distinct() for c in columns]
    vocabulary = known[0]
    for more in known[1:]:
        vocabulary = vocabulary.unionByName(more)
    return wanted.withColumn("_value", F.lower("constraint_value")).join(vocabulary, ["constraint_name", "_value"], "left_anti").drop("_value")


def attribute_text(column: str) -> Column:
    """An attribute as text: an unknown number is empty."""
    return F.when(F.col(column) > 0, F.col(column).cast("string")).otherwise("")


def narrowed(named: DataFrame, events: DataFrame, season: str, gender: str) -> DataFrame:
    """Names that a season and gender of the catalog hold (a semi-join on the name)."""
    wanted = events.where(graph.same_text("season", season) & graph.same_text("gender", gender))
    return named.join(wanted.select("name"), "name", "left_semi")


def never_held(events: DataFrame) -> DataFrame:
    """(season, year, sport): sports of a season that a given year of it never held."""
    games, sports = events.select("season", "year").distinct(), events.select("season", "sport").distinct()
    return games.join(sports, "season").join(events.select("season", "year", "sport"), ["season", "year", "sport"], "left_anti")


def moved_titles(events: DataFrame) -> DataFrame:
    """(name, season, year): for each title, the first year of its season's that has no such title."""
    titles, games = events.select("name", "season").distinct(), events.select("season", "year").distinct()
    absent = titles.join(games, "season").join(events.select("name", "season", "year"), ["name", "season", "year"], "left_anti")
    return absent.groupBy("name", "season").agg(F.min("year").alias("year"))


def leaders(events: DataFrame, keys: list[str], least: int = 4) -> DataFrame:
    """The single event with the most competitors of each group of at least so many; ties are skipped."""
    sized = events.where("competitor_count > 0").withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*keys)))
    top = sized.where(F.col("_n") >= least).withColumn("_rank", F.rank().over(W.partitionBy(*keys).orderBy(F.desc("competitor_count")))).where("_rank = 1")
    return top.withColumn("_tied", F.count(F.lit(1)).over(W.partitionBy(*keys))).where("_tied = 1").drop("_n", "_rank", "_tied")


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, the same for a seed: the first in order of a hash of key and seed."""
    return rows.orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))).cast("binary")), key).limit(n)


#: Events of a listing, articles that support an answer and characters of each.
LISTED, SUPPORTING, SHOWN = 25, 3, 700


def attribute_of(links: DataFrame, events: DataFrame, attribute: str) -> DataFrame:
    """(question_id, event_id, value): an attribute of the event that each question clearly means; empty and unknown ones are null."""
    value = F.nullif(attribute_text(attribute), F.lit("")) if attribute.endswith("_count") else F.nullif(F.col(attribute).cast("string"), F.lit(""))
    return linking.resolved(links).join(events.select("event_id", value.alias("value")), "event_id").select("question_id", "event_id", "value")


def attributes_at_venue(asked: DataFrame, events: DataFrame, attribute: str, shown: Callable[[Column], Column] | None = None) -> DataFrame:
    """(question_id, status, candidates): the attribute of the event at a venue and date, or of each that ties.

    candidates are (event, value) in order of name; status is conclusive for one event, else ambiguous.
    shown may make something shorter of the candidates, once for all questions of a venue and date.
    """
    forms, met = linking.places_met(asked, events)
    found = met.join(events.select("event_id", "name", F.coalesce(F.col(attribute).cast("string"), F.lit("")).alias("value")), "event_id")
    options = F.array_sort(F.collect_list(F.struct(F.col("name").alias("event"), "value")))
    told = found.groupBy("form").agg(F.when(F.count(F.lit(1)) == 1, "conclusive").otherwise("ambiguous").alias("status"), options.alias("candidates"))
    told = told.select("form", "status", (shown(F.col("candidates")) if shown else F.col("candidates")).alias("candidates"))
    same = F.expr("q.venue <=> f.venue and q.date <=> f.date")
    return asked.alias("q").join(forms.alias("f"), same).select("question_id", "form").join(told, "form").select("question_id", "status", "candidates")


def find_events(questions: DataFrame, events: DataFrame) -> DataFrame:
    """(question_id, total, event_ids): for a phrase its ranked links, without one the events that meet the constraints.

    Of a listing the first LISTED by id are named and all counted.
    """
    phrased = linking.link_events(questions.where("phrase is not null and phrase <> ''"), events)
    ranked = F.transform(F.array_sort(F.collect_list(F.struct("rank", "event_id"))), lambda x: x["event_id"])
    linked = phrased.groupBy("question_id").agg(F.count(F.lit(1)).alias("total"), ranked.alias("event_ids"))
    constraints = ("sport", "year", "season", "gender")
    said = lambda c: F.concat(F.lit("="), F.col(c).cast("string"))
    any_, together = F.lit("*"), lambda columns: F.concat_ws("\x01", *columns)
    free = questions.where("phrase is null or phrase = ''").select("question_id", together([F.coalesce(said(c), any_) for c in constraints]).alias("asked"))
    # events alike in their constraints are counted and their first ids taken once; these few stand under each set of constraints that they meet
    own = W.partitionBy(*constraints).orderBy("event_id")
    early = events.select("event_id", *constraints).withColumn("_k", F.row_number().over(own)).where(F.col("_k") <= LISTED).select(F.lit(0).alias("n"), "event_id", *constraints)
    counted = events.groupBy(*constraints).agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(None).alias("event_id"), *constraints)
    each = early.unionByName(counted)
    for c in constraints:
        each = each.withColumn(c, F.explode(F.array_compact(F.array(any_, said(c)))))
    met = settled(each.select("n", "event_id", together(constraints).alias("asked")).join(free.select("asked").distinct(), "asked", "left_semi"))
    total = met.groupBy("asked").agg(F.sum("n").alias("total"))
    placed = met.where("event_id is not null").withColumn("_k", F.row_number().over(W.partitionBy("asked").orderBy("event_id"))).where(F.col("_k") <= LISTED)
    first = placed.groupBy("asked").agg(F.array_sort(F.collect_list("event_id")).alias("event_ids"))
    listed = free.join(total.join(first, "asked"), "asked").select("question_id", "total", "event_ids")
    return linked.unionByName(listed)


def supporting(cited: DataFrame, chunks: DataFrame) -> DataFrame:
    """(question_id, doc_id, passage): the beginning of the first chunk of each question's first cited documents; cited has question_id, doc_id and position."""
    first = cited.withColumn("_k", F.row_number().over(W.partitionBy("question_id").orderBy("position"))).where(F.col("_k") <= SUPPORTING)
    return first.join(chunks.where("chunk_index = 0").select("doc_id", F.substring("text", 1, SHOWN).alias("passage")), "doc_id").select("question_id", "doc_id", "passage")


def ties_broken(ranked: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """The leaders of rank_events, of tied ones only the one whose article says the count again, if just one does; chunks has doc_id = event_id."""
    tied = ranked.where("n_tied > 1").select(*keys, "event_id", "competitor_count")
    said = agent.prose(chunks.join(tied.select(F.col("event_id").alias("doc_id"), "competitor_count"), "doc_id")).where(F.rlike("sentence", F.concat(F.lit("\\b"), F.col("competitor_count").cast("string"), F.lit("\\b"))))
    confirmed = tied.join(said.select(F.col("doc_id").alias("event_id")).distinct(), "event_id", "left_semi")
    single = confirmed.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*keys))).where("_n = 1").select(*keys, F.col("event_id").alias("_winner"))
    return ranked.join(single, keys, "left").where("_winner is null or _winner = event_id").withColumn("n_tied", F.when(F.col("_winner").isNotNull(), 1).otherwise(F.col("n_tied"))).drop("_winner")


def previous_or_linked(questions: DataFrame, events: DataFrame, precedes: DataFrame, attribute: str) -> DataFrame:
    """(question_id, event_id, value, traversal): an attribute of the edition before the one that each question names.

    By the PRECEDES edge of the linked event if it has exactly one; else the phrase is linked again at
    the season's Games before the asked year. questions has question_id, phrase, year and what is given besides.
    """
    current = linking.resolved(linking.link_events(questions, events))
    single = precedes.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("src"))).where("_n = 1").select(F.col("src").alias("event_id"), "dst")
    direct = current.join(single, "event_id").select("question_id", F.col("dst").alias("event_id"), F.lit("PRECEDES").alias("traversal"))
    left = questions.join(direct.select("question_id"), "question_id", "left_anti").join(current.join(events.select("event_id", F.col("season").alias("_season")), "event_id").select("question_id", "_season"), "question_id", "left")
    alone = events.where("season is not null and season <> ''").groupBy("year").agg(F.min("season").alias("_only"), F.count_distinct("season").alias("_n")).where("_n = 1").select("year", "_only")
    left = left.join(alone, "year", "left").withColumn("season", F.coalesce("season", "_season", "_only"))
    back = left.join(previous_year(events), ["season", "year"]).where("previous_year is not null").withColumn("year", F.col("previous_year"))
    again = linking.resolved(linking.link_events(back.select(*questions.columns), events)).select("question_id", "event_id", F.lit("previous_games").alias("traversal"))
    both = direct.unionByName(again)
    return both.join(events.select("event_id", F.nullif(F.col(attribute).cast("string"), F.lit("")).alias("value")), "event_id").select("question_id", "event_id", "value", "traversal")


#: The wordings of templated questions, tried in this order.
TEMPLATES = (
    "how many (.+?) events at the (\\d{4}) (Summer|Winter) Olympics had more than (\\d+)",
    "which (.+?) event at the (\\d{4}) (Summer|Winter) Olympics had the highest",
    "held at (.+?) on (.+?)(?: at the (\\d{4}) (?:Summer|Winter) Olympics)?\\?$",
    "in the (.+?) event at the (Summer|Winter) Olympics held immediately before (\\d{4})",
    "competed in (.+?) at the (\\d{4}) (Summer|Winter) Olympics\\s*[–—-]\\s*(.+)\\?$",
)


def template_answers(questions: DataFrame, events: DataFrame) -> DataFrame:
    """(question_id, template, answer): every answer that the events support for templated questions (question_id, question).

    events has event_id, name, sport, year, season, label, competitor_count, nation_count,
    gold_athlete, venue and start_date. More than one answer means that the question is ambiguous.
    """
    forms = classed_answers(questions, events)
    return forms["asked"].join(forms["answers"], ["template", "form"]).select("question_id", "template", "answer")


def classed_answers(questions: DataFrame, events: DataFrame) -> dict[str, DataFrame]:
    """asked (question_id, template, form) and answers (template, form, answer): what questions of one form have in common is looked up once.

    A form is what a question says to its template.
    """
    from eventgraph.functions import text as tx

    parts = ({"s": 1, "y": 2, "g": 3, "n": 4}, {"s": 1, "y": 2, "g": 3}, {"v": 1, "d": 2, "y": 3}, {"p": 1, "g": 2, "y": 3}, {"s": 1, "y": 2, "g": 3, "e": 4})
    q = F.col("question")
    number = F.coalesce(*[F.when(q.rlike(t), i) for i, t in enumerate(TEMPLATES, 1)])
    named = lambda t, groups: F.to_json(F.struct(*[F.regexp_extract("question", t, g).alias(n) for n, g in groups.items()]))
    form = F.coalesce(*[F.when(F.col("template") == i, named(t, groups)) for i, (t, groups) in enumerate(zip(TEMPLATES, parts), 1)])
    asked = questions.select("question_id", "question", number.alias("template")).where("template is not null").select("question_id", "template", form.alias("form"))
    forms = settled(asked.select("template", "form").distinct())
    of = lambda k: forms.where(F.col("template") == k).select("template", "form", *[F.get_json_object("form", f"$.{n}").alias(n) for n in parts[k - 1]])
    # read once: counts come from joins
    events = settled(events.select("name", "sport", "year", "season", "label", "competitor_count", "nation_count", "gold_athlete", "venue", "start_date"))
    # what sports are called is folded once a sport
    sports = events.select("sport").distinct().withColumn("_sport", tx.fold(F.col("sport")))
    own = events.join(sports, "sport")
    same = F.expr("_sport = s and year = y and season = g")
    games = lambda rows: rows.withColumn("s", tx.fold(F.col("s"))).withColumn("y", F.col("y").cast("int"))
    answer = lambda rows, value: rows.select("template", "form", value.cast("string").alias("answer"))
    sizes = own.groupBy("_sport", "year", "season", "competitor_count").agg(F.count(F.lit(1)).alias("_m"))
    above = F.coalesce(F.sum(F.when(F.col("competitor_count") > F.col("n").cast("long"), F.col("_m"))), F.lit(0))
    counted = games(of(1)).join(sizes, same, "left").groupBy("template", "form").agg(above.alias("answer"))
    most = sizes.where("competitor_count > 0").groupBy("_sport", "year", "season").agg(F.max("competitor_count").alias("competitor_count"))
    highest = games(of(2)).join(most, same).join(own.select("_sport", "year", "season", "competitor_count", "name"), ["_sport", "year", "season", "competitor_count"])
    golden = events.where("gold_athlete is not null and gold_athlete <> ''")
    at = of(3).select("template", "form", tx.compact(F.col("v")).alias("v"), tx.compact(F.col("d")).alias("d"), F.nullif("y", F.lit("")).cast("int").alias("y"))
    places = golden.select("venue", "start_date").distinct().select("*", tx.compact(F.coalesce("venue", F.lit(""))).alias("_v"), tx.compact(F.coalesce("start_date", F.lit(""))).alias("_d"))
    there = at.join(places, F.expr("_v = v and _d = d")).select("template", "form", "y", F.col("venue").alias("_venue"), F.col("start_date").alias("_date"))
    held = there.join(golden, F.expr("_venue <=> venue and _date <=> start_date and (y is null or y = year)"))
    before = of(4).withColumn("y", F.col("y").cast("int"))
    prior = before.join(events.select(F.col("season").alias("_g"), F.col("year").alias("_y")).distinct(), F.expr("_g = g and _y < y")).groupBy("template", "form", "p", "g").agg(F.max("_y").alias("y"))
    label, wanted, sport = tx.tokens(F.col("label")), tx.tokens(F.col("p")), tx.tokens(F.col("sport"))
    fits = (F.size(F.array_except(label, wanted)) == 0) & (F.size(F.array_except(wanted, F.array_union(label, sport))) == 0)
    labels = golden.select("label", "sport", "season", "year").distinct()
    fitting = prior.join(labels, F.expr("season = g and year = y")).where(fits).select("template", "form", *[F.col(c).alias(f"_{c}") for c in ("label", "sport", "season", "year")])
    earlier = fitting.join(golden, F.expr("_label <=> label and _sport <=> sport and _season = season and _year = year"))
    title = F.concat("s", F.lit(" at the "), "y", F.lit(" "), "g", F.lit(" Olympics – "), "e")
    names = events.select("name").distinct().select(F.col("name").alias("_name"), tx.compact(F.col("name")).alias("_key"))
    meant = of(5).select("template", "form", tx.compact(title).alias("_key")).join(names, "_key")
    nations = meant.join(events.where("nation_count > 0"), F.expr("_name = name"))
    found = [answer(counted, F.col("answer")), answer(highest, F.col("name")), answer(held, F.col("gold_athlete")), answer(earlier, F.col("gold_athlete")), answer(nations, F.col("nation_count"))]
    return {"asked": asked, "answers": reduce(DataFrame.unionByName, found)}


def single_answers(questions: DataFrame, events: DataFrame) -> DataFrame:
    """(question_id, answer) of the templated questions that have just one answer; the others' are counted, not listed."""
    forms = classed_answers(questions, events)
    single = forms["answers"].groupBy("template", "form").agg(F.count(F.lit(1)).alias("_n"), F.min("answer").alias("answer")).where("_n = 1")
    return forms["asked"].join(single, ["template", "form"]).select("question_id", "answer")


def agreement(single: DataFrame, results: DataFrame) -> DataFrame:
    """(pipeline, agree, scored): how many of a pipeline's results (qid, pipeline, answer) equal the single answer (question_id, answer) of a templated question."""
    from eventgraph.operators import metrics

    scored = results.join(single.select(F.col("question_id").alias("qid"), F.col("answer").alias("_want")), "qid")
    return scored.groupBy("pipeline").agg(F.count_if(metrics.answer_key(F.col("answer")) == metrics.answer_key(F.col("_want"))).alias("agree"), F.count(F.lit(1)).alias("scored"))
