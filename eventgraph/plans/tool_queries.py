"""Registered queries of linking and composite tools over the articles' events; every hundredth event asks about itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventgraph.operators import ingest, linking, toolkit
from eventgraph.operators.ordering import settled
from eventgraph.plans.proxy import ARTICLES, EVENTS, articles, events
from eventgraph.plans.registry import query
from eventgraph.plans.text_queries import COMPACT, STEMMED
from eventgraph.session import table

PLAIN = "regexp_replace({t}, '[’–—]', '', 'g')"
FOLD = f"lower(strip_accents({PLAIN}))"
STEMS = STEMMED.replace("lower({t})", FOLD)
#: Questions by kind: an exact title, a free phrase with its sport, a label with year and gender, a title with other dashes, constraints alone.
ASKED = f"""
qs as (select event_id question_id, event_id // 100 % 5 k, sport, year, season, gender, label, title,
  case event_id // 100 % 5 when 0 then title when 1 then 'the ' || label || ' event in ' || year when 2 then label when 3 then replace(title, '–', '-') || ' event' end phrase from ar where event_id % 100 = 0),
un as (select question_id, k, case when k in (1, 3, 4) then sport end sport, case when k <> 0 then year end as year, case when k = 3 then season end season, case when k = 2 then gender end gender,
  case when k = 3 and season is not null then label || ' event' else phrase end phrase from qs),
lb as (select event_id, title as name, sport, year, season, gender, case when season is null then title else label end label from ar),
ex as (select question_id, arg_max(event_id, event_id) event_id from qs join lb on qs.k = 0 and {COMPACT.format(t="title")} = {COMPACT.format(t="name")} group by question_id),
ws as (select question_id, sport, year, season, gender, list_distinct(list_concat(list_filter({STEMS.format(t="phrase")}, lambda w: not list_contains(list_concat(['the', 'at', 'in', 'of', 'event', 'olympic', 'olympics', 'game', 'games', 'edition', year::varchar], list_concat(coalesce({STEMS.format(t="sport")}, []), coalesce({STEMS.format(t="season")}, []))), w)), coalesce({STEMS.format(t="gender")}, []))) w,
  len(list_filter({STEMS.format(t="phrase")}, lambda w: not list_contains(list_concat(['the', 'at', 'in', 'of', 'event', 'olympic', 'olympics', 'game', 'games', 'edition', year::varchar], list_concat(coalesce({STEMS.format(t="sport")}, []), coalesce({STEMS.format(t="season")}, []))), w))) > 0 has_words from un where k in (1, 2, 3)),
ll as (select *, {STEMS.format(t="label")} l from lb),
sc as (select question_id, event_id, name, round(2.0 * len(list_intersect(w, l)) / (len(w) + len(l)), 3) score from ws join ll on has_words and (ws.sport is null or ws.sport = ll.sport) and (ws.year is null or ws.year = ll.year) and (ws.season is null or ws.season = ll.season) and (ws.gender is null or ws.gender = ll.gender)
  where list_sort(list_filter(w, lambda x: regexp_full_match(x, '[0-9]+'))) = list_sort(list_filter(l, lambda x: regexp_full_match(x, '[0-9]+')))),
lk as (select question_id, event_id, 1.0 score, 'exact_title' as method, 1 as rank from ex union all select * from (select question_id, event_id, score, 'label_token_f1', row_number() over (partition by question_id order by score desc, name, event_id) r from sc where score >= 0.5) where r <= 10),
rs as (select question_id, max(case when rank = 1 then event_id end) event_id from lk group by question_id having max(case when rank = 2 then score end) is null or (max(case when rank = 1 then score end) = 1 and max(case when rank = 2 then score end) < 1) or round(max(case when rank = 1 then score end) - max(case when rank = 2 then score end), 3) >= 0.15)"""
WITH = f"with {EVENTS}, {ARTICLES}, {ASKED}"


def catalog(spark, folder, counted=True):
    """Events under the titles of their articles."""
    season = F.when(F.col("season") == "F", "Summer").when(F.col("season") == "O", "Winter")
    gender = F.element_at(F.array(F.lit("Women"), F.lit("Men"), F.lit("Mixed"), F.lit(None).cast("string")), (F.col("event_id") % 4 + 1).cast("int"))
    label = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("Women’s ", "Men’s ", "Mixed ", "")]), (F.col("event_id") % 4 + 1).cast("int")), "name")
    title = F.concat("sport", F.lit(" at the "), F.col("year").cast("string"), F.coalesce(F.concat(F.lit(" "), season, F.lit(" Olympics – "), label), F.lit(" Games")))
    counts = ["competitor_count", "nation_count"] if counted else []
    return events(spark, folder, counted).select("event_id", title.alias("name"), label.alias("label"), "sport", "year", season.alias("season"), gender.alias("gender"), "venue", "start_date", "gold_athlete", *counts)


def asked(known):
    kind = F.floor(F.col("event_id") / 100) % 5
    phrase = F.when(kind == 0, F.col("name")).when(kind == 1, F.concat(F.lit("the "), "label", F.lit(" event in "), F.col("year").cast("string"))).when(kind == 2, F.col("label")).when(kind == 3, F.concat(F.replace("name", F.lit("–"), F.lit("-")), F.lit(" event")))
    given = lambda c, *kinds: F.when(kind.isin(*kinds), F.col(c)).alias(c)
    return known.where("event_id % 100 = 0").select(F.col("event_id").alias("question_id"), phrase.alias("phrase"), given("sport", 1, 4), given("year", 2, 4), F.lit(None).cast("string").alias("season"), given("gender", 2))


@query("link_event", f"{WITH} select question_id, event_id, score::double score, method, rank::int rank from lk")
def link_event(spark, folder):
    known = catalog(spark, folder, counted=False)
    return linking.link_events(asked(known), known)


@query("attribute_of_linked", f"{WITH} select question_id, event_id, nullif(case when competitor_count > 0 then competitor_count::varchar else '' end, '') as value from rs join ar using (event_id)")
def attribute_of_linked(spark, folder):
    known = catalog(spark, folder, counted=False)
    return toolkit.attribute_of(linking.link_events(asked(known), known), catalog(spark, folder), "competitor_count")


@query("find_events", f"{WITH}, fr as (select q.question_id, e.event_id, row_number() over (partition by q.question_id order by e.event_id) n, count(*) over (partition by q.question_id) total from qs q join ar e on q.k = 4 and q.sport = e.sport and q.year = e.year) select question_id, count(*) total, md5(string_agg(event_id, ',' order by rank)) ids_md5 from lk group by question_id union all select question_id, any_value(total), md5(string_agg(event_id, ',' order by event_id)) from fr where n <= 25 group by question_id")
def find_events(spark, folder):
    known = catalog(spark, folder, counted=False)
    found = toolkit.find_events(asked(known), known)
    return found.select("question_id", "total", F.md5(F.array_join(F.col("event_ids").cast("array<string>"), ",").cast("binary")).alias("ids_md5"))


@query("gender_names", "with g as (select * from (values (0, 'Women’s'), (1, 'men'), (2, 'MENS'), (3, 'mixed'), (4, 'Womens''s'), (5, 'wo men')) t(i, p)) select p_partkey phrase_id, case p_partkey % 6 when 0 then 'Women' when 3 then 'Mixed' when 5 then 'Women' when 4 then null else 'Men' end as name from part where p_partkey % 6 <> 4")
def gender_names(spark, folder):
    phrase = F.element_at(F.array(*[F.lit(x) for x in ("Women’s", "men", "MENS", "mixed", "Womens's", "wo men")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    genders = catalog(spark, folder, counted=False).where("gender is not null").select(F.col("gender").alias("name"))
    return linking.resolve_gender(table(spark, folder, "part").select(F.col("p_partkey").alias("phrase_id"), phrase.alias("phrase")), genders)


@query("venue_candidates", f"{WITH}, v as (select a.event_id question_id, b.event_id, b.title, b.gold_athlete from (select * from ev where event_id % 100 = 0 and venue is not null) a join (select ev.*, title from ev join ar using (event_id)) b on a.venue = b.venue and a.start_date = b.start_date) select question_id, case when count(*) = 1 then 'conclusive' else 'ambiguous' end status, md5(string_agg(title || '=' || gold_athlete, ';' order by title, gold_athlete)) candidates_md5 from v group by question_id")
def venue_candidates(spark, folder):
    known = catalog(spark, folder, counted=False)
    wanted = known.where("event_id % 100 = 0 and venue is not null").select(F.col("event_id").alias("question_id"), "venue", F.col("start_date").alias("date"))
    shown = lambda found: F.md5(F.array_join(F.transform(found, lambda c: F.concat(c["event"], F.lit("="), c["value"])), ";").cast("binary"))
    found = toolkit.attributes_at_venue(wanted, known, "gold_athlete", shown)
    return found.select("question_id", "status", F.col("candidates").alias("candidates_md5"))


@query("supporting_passages", f"with {EVENTS}, {ARTICLES}, c as (select ar.event_id, ar.season, ar.title, ar.event_id // 100 question_id, ar.event_id % 7 p, row_number() over (partition by ar.event_id // 100 order by ar.event_id % 7, ar.event_id) k from ar) select question_id, event_id doc_id, length('Title: ' || title) > 0 has_title from c where k <= 3")
def supporting_passages(spark, folder):
    docs = articles(spark, folder)
    cited = docs.select(F.floor(F.col("doc_id") / 100).alias("question_id"), "doc_id", (F.col("doc_id") % 7 * 10_000_000_000 + F.col("doc_id")).alias("position"))
    cut = ingest.chunks(docs.withColumn("header", F.concat(F.lit("Title: "), "title")))
    return toolkit.supporting(cited, cut).select("question_id", "doc_id", F.startswith("passage", F.lit("Title: ")).alias("has_title"))


#: Every hundredth event asks one of the templated questions; Games that are not of the grammar are left out.
TEMPLATED = """
gr as (select ar.*, gold_athlete from ar join (select event_id, gold_athlete from ev) using (event_id) where season is not null),
tq as (select *, event_id // 100 % 5 + 1 t from gr where event_id % 100 = 0),
ta as (select event_id question_id, t template, (select count(*) from gr g where g.sport = q.sport and g.year = q.year and g.season = q.season and g.competitor_count > 3)::varchar answer from tq q where t = 1
  union all select q.event_id, q.t, g.title from tq q join (select *, max(competitor_count) over (partition by sport, year, season) best from gr) g on q.t = 2 and g.sport = q.sport and g.year = q.year and g.season = q.season and g.competitor_count = best and best > 0
  union all select q.event_id, q.t, g.gold_athlete from tq q join gr g on q.t = 3 and g.venue = q.venue and g.start_date = q.start_date and (q.event_id % 200 <> 0 or g.year = q.year)
  union all select q.event_id, q.t, g.gold_athlete from tq q join gr g on q.t = 4 and g.season = q.season and g.label = q.label and g.year = (select max(year) from gr p where p.season = q.season and p.year < q.year)
  union all select q.event_id, q.t, g.nation_count::varchar from tq q join gr g on q.t = 5 and g.title = q.title and g.nation_count > 0)"""


def templated(known):
    kind, year = F.floor(F.col("event_id") / 100) % 5, F.col("year").cast("string")
    games = F.concat(F.lit(" at the "), year, F.lit(" "), "season", F.lit(" Olympics"))
    question = (
        F.when(kind == 0, F.concat(F.lit("how many "), "sport", F.lit(" events"), games, F.lit(" had more than 3 competitors?")))
        .when(kind == 1, F.concat(F.lit("which "), "sport", F.lit(" event"), games, F.lit(" had the highest number of competitors?")))
        .when(kind == 2, F.concat(F.lit("Who won the event held at "), "venue", F.lit(" on "), "start_date", F.when(F.col("event_id") % 200 == 0, games).otherwise(""), F.lit("?")))
        .when(kind == 3, F.concat(F.lit("Who won gold in the "), "label", F.lit(" event at the "), "season", F.lit(" Olympics held immediately before "), year, F.lit("?")))
        .otherwise(F.concat(F.lit("How many nations competed in "), "name", F.lit("?")))
    )
    return known.where("event_id % 100 = 0").select(F.col("event_id").alias("question_id"), question.alias("question")).where("question is not null")


@query("template_answers", f"with {EVENTS}, {ARTICLES}, {TEMPLATED} select question_id, template::int template, answer from ta")
def template_answers(spark, folder):
    known = catalog(spark, folder).where("season is not null")
    return toolkit.template_answers(templated(known), known)


@query("template_agreement", f"with {EVENTS}, {ARTICLES}, {TEMPLATED}, s as (select question_id, min(answer) w from ta group by question_id having count(*) = 1), r as (select question_id, 'same' pipeline, w a from s union all select question_id, 'partly', case when question_id % 3 = 0 then w else 'x' end from s) select pipeline, count(*) filter (regexp_replace(lower(a), '[^a-z0-9]', '', 'g') = regexp_replace(lower(w), '[^a-z0-9]', '', 'g')) agree, count(*) scored from r join s using (question_id) group by pipeline")
def template_agreement(spark, folder):
    known = catalog(spark, folder).where("season is not null")
    best = settled(toolkit.single_answers(templated(known), known))
    results = lambda pipeline, answer: best.select(F.col("question_id").alias("qid"), F.lit(pipeline).alias("pipeline"), answer.alias("answer"))
    partly = F.when(F.col("question_id") % 3 == 0, F.col("answer")).otherwise("x")
    return toolkit.agreement(best, results("same", F.col("answer")).unionByName(results("partly", partly)))
