"""Registered queries over a corpus of articles that is made of the events: its parse, chunks, chronology and graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventgraph.operators import corpus, ingest
from eventgraph.operators.ordering import settled
from eventgraph.plans.proxy import ARTICLES, EVENTS, alike_articles, articles
from eventgraph.plans.registry import query

WITH = f"with {EVENTS}, {ARTICLES}"
MASK = "((case when year - 1988 between 0 and 39 then 1 << ((year - 1988) // 2)::int else 0 end) | case season when 'Summer' then 1 << 20 when 'Winter' then 1 << 21 else 0 end)::int"
HEADER = "concat_ws(' | ', 'Title: ' || title, 'Year: ' || year, 'Season: ' || season, 'Sport: ' || sport, 'Event: ' || label, 'Venue: ' || venue, case when competitor_count > 0 then 'Competitors: ' || competitor_count end, 'Nations: ' || nation_count, 'Gold: ' || gold)"


def read(spark, folder):
    """What the articles say that edges are made of, read once."""
    return settled(corpus.parsed(articles(spark, folder)).select(*corpus.READ))


@query("corpus_events", f"{WITH} select event_id, title as name, year, coalesce(season, '') season, sport, coalesce(gender, '') gender, coalesce(venue, '') venue, competitor_count, nation_count, gold gold_athlete, 'FRA' gold_noc, {MASK} filter_mask, coalesce(prev::varchar, '') prev_event_id, coalesce(next::varchar, '') next_event_id from ar left join ch using (event_id)")
def corpus_events(spark, folder):
    rows = corpus.graph_frames(articles(spark, folder))["events"]
    return rows.select("event_id", "name", "year", "season", "sport", "gender", "venue", "competitor_count", "nation_count", "gold_athlete", "gold_noc", "filter_mask", F.col("prev_event_id").cast("string").alias("prev_event_id"), F.col("next_event_id").cast("string").alias("next_event_id"))


@query("corpus_header", f"{WITH} select event_id doc_id, md5({HEADER}) header_md5 from ar")
def corpus_header(spark, folder):
    return corpus.parsed(articles(spark, folder)).select("doc_id", F.md5(F.col("header").cast("binary")).alias("header_md5"))


@query("corpus_chronology", f"{WITH} select event_id doc_id, prev prev_event_id, next next_event_id, coalesce(nullif(b, 0), a, 0) time_diff from ch")
def corpus_chronology(spark, folder):
    return corpus.chronology(articles(spark, folder))


@query("corpus_edges", f"{WITH}, e as (select event_id src, event_id::varchar dst, 'documented_in' kind, null as value from ar union all select event_id, 'v_' || regexp_replace(lower(venue), '[^a-z0-9]', '_', 'g')[:60], 'held_at', start_date from ar where venue is not null union all select event_id, prev::varchar, 'precedes', coalesce(nullif(b, 0), a, 0)::varchar from ch where prev is not null union all select event_id, next::varchar, 'succeeds', coalesce(nullif(b, 0), a, 0)::varchar from ch where next is not null) select src, dst, kind, value from e")
def corpus_edges(spark, folder):
    frames = corpus.edge_frames(read(spark, folder))
    parts = [frames[k].select("src", F.col("dst").cast("string").alias("dst"), F.lit(k).alias("kind"), "value") for k in ("documented_in", "held_at", "precedes", "succeeds")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("corpus_venues", f"{WITH} select 'v_' || regexp_replace(lower(venue), '[^a-z0-9]', '_', 'g')[:60] venue_id, arg_max(venue, event_id) as name from ar where venue is not null group by 1")
def corpus_venues(spark, folder):
    return corpus.edge_frames(corpus.parsed(articles(spark, folder)))["venues"]


#: Paragraphs packed by a fold: done chunks, the open one's paragraphs and its tokens.
PACKED = """list_reduce(list_transform(ps, lambda p: {{'done': []::varchar[], 'open': [p], 'size': greatest(1, length(p) // 4)::bigint}}), lambda s, x: case when len(s.open) > 0 and s.size + x.size > 400
  then {{'done': list_append(s.done, array_to_string(s.open, chr(10) || chr(10))), 'open': [s.open[-1], x.open[1]], 'size': greatest(1, length(s.open[-1]) // 4)::bigint + x.size}}
  else {{'done': s.done, 'open': list_append(s.open, x.open[1]), 'size': s.size + x.size}} end, {{'done': []::varchar[], 'open': []::varchar[], 'size': 0::bigint}})"""
BODY = "string_split(replace(coalesce(text, ''), chr(10), chr(10) || chr(10)), chr(10) || chr(10))"


@query("corpus_chunks", f"""{WITH}, bx as (select ar.*, text, '[Infobox Olympic event]' || chr(10) || '  event: ' || label || chr(10) || '  games: ' || year || ' Games' || coalesce(chr(10) || '  Venue = ' || venue, '') || chr(10) || '  date: ' || start_date
  || case when competitor_count > 0 then chr(10) || '  competitors: ' || competitor_count || case when event_id % 11 = 0 then '000' else '' end else '' end || chr(10) || '  nations | ' || nation_count || chr(10) || '  gold: ' || replace(gold, 'Dombi, Ro', 'DombiRo') || ' (FRA)' || chr(10) || '  colour: red' box from ar left join documents using (doc_id)),
ps as (select *, list_filter(list_transform(list_concat([box, 'There were ' || competitor_count || ' competitors from many nations.'], {BODY}), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> '') ps from bx),
fo as (select *, {PACKED.replace('{{', '{').replace('}}', '}')} f from ps), al as (select *, list_append(f.done, array_to_string(f.open, chr(10) || chr(10))) cs from fo)
select event_id doc_id, (i - 1)::int chunk_index, event_id || '#' || (i - 1) chunk_id, case when i > 1 then event_id || '#' || (i - 2) else '' end prev_chunk_id, case when i < len(cs) then event_id || '#' || i else '' end next_chunk_id,
  md5(((case when i = 1 then {HEADER} else 'Title: ' || title end) || chr(10) || chr(10) || cs[i])[:8000]) text_md5, length(cs[i][:4000])::int raw_length from (select *, unnest(range(1, len(cs) + 1)) i from al)""")
def corpus_chunks(spark, folder):
    told = corpus.parsed(alike_articles(spark, folder))  # an infobox and an opening never reach into a body
    cut = ingest.stored_texts(ingest.chunks_behind(told, "doc_ids"))
    cut = cut.select("doc_ids", "n_chunks", "chunk_index", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.length("raw_text").alias("raw_length"))
    return ingest.stored_pointers(ingest.named_chunks(cut.withColumn("doc_id", F.explode("doc_ids")).drop("doc_ids")))


@query("corpus_totals", f"{WITH} select 'events' as name, count(*) n from ar union all select 'documents', count(*) from ar union all select 'venues', count(distinct regexp_replace(lower(venue), '[^a-z0-9]', '_', 'g')[:60]) from ar union all select 'held_at', count(*) from ar where venue is not null union all select 'documented_in', count(*) from ar union all select 'precedes', count(prev) from ch union all select 'succeeds', count(next) from ch")
def corpus_totals(spark, folder):
    known = read(spark, folder)
    return corpus.totals({"documents": known, "events": corpus.admitted(known), **corpus.edge_frames(known)})
