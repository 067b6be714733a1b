"""Entity linking as joins on tokens: no phrase is compared with a label it shares no word with."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventgraph.functions import text as tx
from eventgraph.operators import setjoin
from eventgraph.operators.ordering import settled

LEAST, MARGIN, KEPT = 0.5, 0.15, 10
#: What is told of a question, and what an event has besides its name.
TOLD = ("sport", "year", "season", "gender")
#: Words that frame a question and name no event, and titles as questions write them.
FRAMING = "the at in of event olympic olympics game games edition".split()
TITLED = "(?i)^(.+?)\\s+at the\\s+(\\d{4})\\s+(\\w+)\\s+Olympics\\s*[–—-]\\s*(.+)$"


def numbers(tokens: Column) -> Column:
    return F.array_sort(F.filter(tokens, lambda t: t.rlike("^[0-9]+$")))


def token_f1(phrases: DataFrame, labels: DataFrame) -> DataFrame:
    """(phrase_id, label_id, score): token F1 of at least LEAST; different numbers halve it.

    phrases has phrase_id and phrase, labels has label_id and label. Halved scores never reach LEAST
    (numbers are tokens, so the F1 is below 1 where they differ); so pairs must have equal numbers.
    """
    grouped = lambda rows, text: rows.withColumn("tokens", tx.tokens(F.col(text))).withColumn("group", F.array_join(numbers(F.col("tokens")), " "))
    left = grouped(phrases.select("phrase_id", "phrase", F.col("phrase_id").alias("row_id")), "phrase").drop("phrase")
    right = grouped(labels.select("label_id", "label", F.col("label_id").alias("row_id")), "label").drop("label")
    met = setjoin.similar_pairs(left, right, LEAST - 0.0005)
    score = F.round(setjoin.dice(F.col("n"), F.size("left.tokens"), F.size("right.tokens")), 3)
    return met.select("left.phrase_id", "right.label_id", score.alias("score")).where(F.col("score") >= LEAST)


def ranked(matches: DataFrame) -> DataFrame:
    """The best matches of each phrase, with whether they resolve it: alone, exact before all others, or ahead by MARGIN."""
    order = W.partitionBy("phrase_id").orderBy(F.desc("score"), "label_id")
    top = matches.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= KEPT)
    second = F.max(F.when(F.col("rank") == 2, F.col("score"))).over(W.partitionBy("phrase_id"))
    first = F.max(F.when(F.col("rank") == 1, F.col("score"))).over(W.partitionBy("phrase_id"))
    resolved = second.isNull() | ((first == 1.0) & (second < 1.0)) | (F.round(first - second, 3) >= MARGIN)
    return top.withColumn("resolved", resolved)


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def resolve_name(phrases: DataFrame, names: DataFrame) -> DataFrame:
    """(phrase_id, name): equal token sets first, else the best Jaccard of at least LEAST if it is alone.

    phrases has phrase_id and phrase, names has name. Only names that share a token are compared.
    """
    left = phrases.select("phrase_id", tx.tokens(F.col("phrase")).alias("_p"))
    right = names.select("name", tx.tokens(F.col("name")).alias("_n"))
    shared = left.withColumn("token", F.explode("_p")).join(right.withColumn("token", F.explode("_n")), "token").select("phrase_id", "name", "_p", "_n").distinct()
    scored = shared.select("phrase_id", "name", F.round(jaccard(F.col("_p"), F.col("_n")), 6).alias("score")).where(F.col("score") >= LEAST)
    order = W.partitionBy("phrase_id").orderBy(F.desc("score"), "name")
    top = scored.withColumn("_k", F.row_number().over(order)).withColumn("_next", F.lead("score").over(order)).where("_k = 1")
    return top.where((F.col("score") == 1.0) | F.col("_next").isNull() | (F.col("score") > F.col("_next"))).select("phrase_id", "name", "score")


def longest_within(phrases: DataFrame, names: DataFrame) -> DataFrame:
    """(phrase_id, name): the longest name all of whose tokens are in the phrase (the last by name of equals)."""
    worded = settled(phrases.select("phrase").distinct().select("phrase", F.array_sort(tx.tokens(F.col("phrase"))).alias("_words")))  # equal phrases are folded once
    forms = settled(worded.where(F.size("_words") > 0).select("_words").distinct().withColumn("_form", F.monotonically_increasing_id()))
    # of names with equal words the last one stands for all; it meets phrases under its rarest word, one row a name
    keys = names.select("name", F.array_sort(tx.tokens(F.col("name"))).alias("_n")).where(F.size("_n") > 0)
    kinds = settled(keys.groupBy("_n").agg(F.max(F.struct(F.length("name").alias("length"), "name")).alias("_last")))
    often = forms.select(F.explode("_words").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("_often"))
    rarest = kinds.select("_n", "_last", F.explode("_n").alias("token")).join(often, "token", "left").groupBy("_n", "_last").agg(F.min_by("token", F.struct(F.coalesce("_often", F.lit(0)), "token")).alias("token"))
    met = forms.select("_form", "_words", F.explode("_words").alias("token")).join(rarest, "token").where(F.size(F.array_except("_n", "_words")) == 0)
    found = met.groupBy("_form").agg(F.max(F.struct(F.size("_n").alias("size"), "_last.length", "_last.name")).alias("_best"))
    named = forms.join(found, "_form").select("_words", F.col("_best.name").alias("name"))
    return phrases.join(worded.join(named, "_words"), "phrase").select("phrase_id", "name")


def exact_titles(phrases: DataFrame, titles: DataFrame) -> DataFrame:
    """(phrase_id, title_id): titles equal but for spaces, signs and case; of equal titles the later one."""
    keyed = titles.groupBy(tx.compact(F.col("title")).alias("_key")).agg(F.max("title_id").alias("title_id"))
    return phrases.select("phrase_id", tx.compact(F.col("phrase")).alias("_key")).join(keyed, "_key").select("phrase_id", "title_id")


def at_venue_date(asked: DataFrame, events: DataFrame) -> DataFrame:
    """(question_id, event_id, score): venue and date matches, only the best score of each question.

    Days and months must be equal, one venue must hold the other, and the asked years be among the
    event's. 1.0: equal venue and date; 0.6, and 0.1 more for an equal venue or an equal date text.
    Distinct venues are matched once; questions and events then meet on venue and date.
    """
    same = F.expr("q.venue <=> f.venue and q.date <=> f.date")
    forms, found = places_met(asked, events)
    return asked.select("question_id", "venue", "date").alias("q").join(forms.alias("f"), same).select("question_id", "form").join(found, "form").select("question_id", "event_id", "score")


def places_met(asked: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(venue, date, form) of what is asked and (form, event_id, score) of what at_venue_date finds: each venue and date is looked up once."""
    forms = settled(asked.select("venue", "date").distinct().withColumn("form", F.monotonically_increasing_id()))
    left = forms.select("form", tx.compact(F.col("venue")).alias("_venue"), tx.date_keys(F.col("date")).alias("_k"), tx.compact(F.col("date")).alias("_date"))
    left = left.select("form", "_venue", "_date", F.to_json(F.struct("_k.days", "_k.months")).alias("_at"), F.col("_k.years").alias("_years"))
    kinds = settled(events.select("venue", "start_date").distinct())
    right = kinds.select("venue", "start_date", tx.compact(F.col("venue")).alias("_v"), tx.date_keys(F.col("start_date")).alias("_d"), tx.compact(F.col("start_date")).alias("_t"))
    right = right.select(F.col("venue").alias("_at_venue"), F.col("start_date").alias("_on"), "_v", "_t", F.to_json(F.struct("_d.days", "_d.months")).alias("_at"))
    within = setjoin.contained(left.select("_venue"), right.select("_v")).toDF("_venue", "_v")
    equal = (F.col("_venue") == F.col("_v")).cast("int") + (F.col("_date") == F.col("_t")).cast("int")
    score = F.when(equal == 2, 1.0).otherwise(F.round(0.6 + 0.1 * equal, 1)).alias("score")
    met = left.join(within, "_venue").join(right, ["_v", "_at"]).select("form", "_years", "_at_venue", "_on", score)
    # the best score is found among venues, dates and years; only the events of those that reach it are looked up
    years = events.select("venue", "start_date", F.col("year").cast("string").alias("_y")).distinct()
    there = F.expr("_at_venue <=> venue and _on <=> start_date")
    held = met.join(years, there).where(F.size(F.array_except("_years", F.array("_y"))) == 0)
    best = F.max("score").over(W.partitionBy("form"))
    kept = held.withColumn("_best", best).where("score = _best").select("form", "_at_venue", "_on", "_y", "score")
    own = events.select("event_id", "venue", "start_date", F.col("year").cast("string").alias("_year"))
    found = kept.join(own, there & F.expr("_y <=> _year")).select("form", "event_id", "score")
    return forms, found


def label_of(name: Column) -> Column:
    """The part of a title behind its first dash between spaces."""
    return F.element_at(F.split(name, "\\s[–—-]\\s", 2), -1)


def resolve_gender(phrases: DataFrame, genders: DataFrame) -> DataFrame:
    """(phrase_id, name): the gender that a phrase is, with or without an s at its end; genders has name."""
    key = F.replace(tx.fold(F.col("name")), F.lit(" "), F.lit(""))
    forms = genders.distinct().select("name", F.explode(F.array(key, F.concat(key, F.lit("s")))).alias("_key"))
    return phrases.select("phrase_id", tx.compact(F.col("phrase")).alias("_key")).join(forms, "_key").groupBy("phrase_id").agg(F.min("name").alias("name"))


def resolve_season(phrases: DataFrame, seasons: DataFrame) -> DataFrame:
    """(phrase_id, name): the season that a phrase is; seasons has name."""
    known = seasons.distinct().select("name", tx.fold(F.col("name")).alias("_key"))
    return phrases.select("phrase_id", tx.fold(F.col("phrase")).alias("_key")).join(known, "_key").groupBy("phrase_id").agg(F.min("name").alias("name"))


def understood(questions: DataFrame, events: DataFrame) -> DataFrame:
    """Questions (question_id, phrase, sport, year, season, gender; null: not given) with what their phrases tell.

    A phrase in title form gives sport, year and season where they are not given and is left with the
    event's label; a free phrase gives a year if just one known year stands in it, and the longest
    sport name all of whose words do.
    """
    titled = F.col("phrase").rlike(TITLED)
    part = lambda k: F.when(titled, F.regexp_extract("phrase", TITLED, k))
    cut = questions.select("*", part(1).alias("_sport"), part(2).cast("int").alias("_year"), part(3).alias("_season"), F.coalesce(part(4), "phrase").alias("_phrase"))
    sports = events.where("sport is not null and sport <> ''").select(F.col("sport").alias("name")).distinct()
    seasons = events.where("season is not null and season <> ''").select(F.col("season").alias("name")).distinct()
    named = lambda rows, column: rows.where(F.col(column).isNotNull()).select(F.col("question_id").alias("phrase_id"), F.col(column).alias("phrase"))
    give = lambda rows, found, column: rows.join(found.select(F.col("phrase_id").alias("question_id"), F.col("name").alias("_found")), "question_id", "left").withColumn(column, F.coalesce(F.col(column), "_found")).drop("_found")
    told = give(cut, resolve_name(named(cut, "_sport"), sports), "sport")
    told = give(told, resolve_season(named(told, "_season"), seasons), "season").withColumn("year", F.coalesce("year", "_year"))
    years = events.where("year > 0").select(F.col("year").cast("string").alias("_y")).distinct()
    words = told.where("year is null").select("question_id", F.explode(tx.tokens(F.col("_phrase"))).alias("_y")).where("length(_y) = 4")
    single = words.join(years, "_y").groupBy("question_id").agg(F.count(F.lit(1)).alias("_k"), F.max(F.col("_y").cast("int")).alias("_known")).where("_k = 1")
    told = told.join(single.select("question_id", "_known"), "question_id", "left").withColumn("year", F.coalesce("year", "_known"))
    told = give(told, longest_within(named(told.where("sport is null"), "_phrase"), sports), "sport")
    return told.select(*[c for c in questions.columns if c != "phrase"], F.col("_phrase").alias("phrase"))


def alike(events: DataFrame) -> DataFrame:
    """(name, sport, year, season, gender, last_id, first_ids): the events that are alike in these, by their last id and their KEPT first ones."""
    keys = ("name", *TOLD)
    last = events.groupBy(*keys).agg(F.max("event_id").alias("last_id"))
    early = events.select(*keys, "event_id").withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy("event_id"))).where(F.col("_k") <= KEPT)
    first = early.groupBy(*keys).agg(F.array_sort(F.collect_list("event_id")).alias("first_ids"))
    same = reduce(lambda x, c: x & F.col(f"l.{c}").eqNullSafe(F.col(f"f.{c}")), keys, F.lit(True))
    return last.alias("l").join(first.alias("f"), same).select(*[f"l.{c}" for c in keys], "last_id", "first_ids")


def link_events(questions: DataFrame, events: DataFrame) -> DataFrame:
    """(question_id, event_id, score, method, rank): the best events of each phrase, ten at most.

    questions has question_id, phrase and what is given of sport, year, season and gender; events has
    event_id, name and these four. A title that is equal but for spaces and signs decides (of equal
    titles the later event). Else the F1 of the phrase's words, framing and constraints left out,
    and the label's words counts, for events that meet the constraints; numbers must be the same, and a given
    gender counts as a word of the phrase.

    Equal questions are linked once, against the distinct titles: of events alike in all that a link looks at, the KEPT
    first ids stand for the rest, since no ranking reads further.
    """
    kinds = settled(alike(events).withColumn("row_id", F.monotonically_increasing_id()))
    titles = kinds.groupBy(tx.compact(F.col("name")).alias("_key")).agg(F.max(F.struct("last_id", "year")).alias("_t"))
    exact = questions.select("question_id", F.col("year").alias("_asked"), tx.compact(F.col("phrase")).alias("_key")).join(titles, "_key").where("_asked is null or _asked = _t.year")
    exact = exact.select("question_id", F.col("_t.last_id").alias("event_id"), F.lit(1.0).alias("score"), F.lit("exact_title").alias("method"), F.lit(1).alias("rank"))
    asked = questions.join(exact.select("question_id"), "question_id", "left_anti").select("question_id", "phrase", *TOLD)
    forms = settled(asked.select("phrase", *TOLD).distinct().withColumn("question_id", F.monotonically_increasing_id()))
    told = understood(forms, kinds)
    empty = F.array().cast("array<string>")
    of = lambda c: F.coalesce(tx.tokens(F.col(c)), empty)
    noise = F.concat(F.array(*[F.lit(w) for w in FRAMING]), of("sport"), of("season"), F.coalesce(F.array(F.col("year").cast("string")), empty))
    wanted = told.select(F.col("question_id").alias("row_id"), *[F.col(c).alias(f"_{c}") for c in TOLD], F.array_except(tx.tokens(F.col("phrase")), noise).alias("tokens")).where(F.size("tokens") > 0)
    wanted = wanted.withColumn("tokens", F.when(F.coalesce("_gender", F.lit("")) != "", F.array_union("tokens", of("_gender"))).otherwise(F.col("tokens")))
    labels = kinds.select("row_id", "name", *TOLD, "first_ids", tx.tokens(label_of(F.col("name"))).alias("tokens"))
    grouped = lambda rows: settled(rows.withColumn("group", F.array_join(numbers(F.col("tokens")), " ")))
    met = setjoin.similar_pairs(grouped(wanted), grouped(labels), LEAST - 0.0005)
    meets = " and ".join(f"(left._{c} is null or left._{c} = right.{c})" for c in TOLD)
    score = F.round(setjoin.dice(F.col("n"), F.size("left.tokens"), F.size("right.tokens")), 3)
    scored = met.where(meets).select(F.col("left.row_id").alias("_form"), "right.name", "right.first_ids", score.alias("score")).where(F.col("score") >= LEAST)
    best = lambda rows, *ties: rows.withColumn("rank", F.row_number().over(W.partitionBy("_form").orderBy(F.desc("score"), "name", *ties))).where(F.col("rank") <= KEPT)
    top = best(best(scored, F.col("first_ids")[0]).select("_form", "name", "score", F.explode("first_ids").alias("event_id")), "event_id")
    same = reduce(lambda x, c: x & F.col(f"q.{c}").eqNullSafe(F.col(f"f.{c}")), ("phrase", *TOLD), F.lit(True))
    numbered = asked.alias("q").join(forms.alias("f"), same).select("q.question_id", F.col("f.question_id").alias("_form"))
    linked = numbered.join(top, "_form").select("question_id", "event_id", "score", F.lit("label_token_f1").alias("method"), "rank")
    return exact.unionByName(linked)


def resolved(links: DataFrame) -> DataFrame:
    """(question_id, event_id): the one event of each question whose links have a clear winner."""
    first = lambda k: F.max(F.when(F.col("rank") == k, F.col("score")))
    best = links.groupBy("question_id").agg(first(1).alias("_1"), first(2).alias("_2"), F.max(F.when(F.col("rank") == 1, F.col("event_id"))).alias("event_id"))
    clear = F.col("_2").isNull() | ((F.col("_1") == 1.0) & (F.col("_2") < 1.0)) | (F.round(F.col("_1") - F.col("_2"), 3) >= MARGIN)
    return best.where(clear).select("question_id", "event_id")
