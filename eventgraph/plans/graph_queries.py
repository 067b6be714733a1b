"""Registered queries over the event graph, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventgraph.functions import tools
from eventgraph.operators import graph, toolkit, views
from eventgraph.plans.proxy import EVENTS, events
from eventgraph.plans.registry import query
from eventgraph.session import table

WITH = f"with {EVENTS}"
BACK = "pr as (select * from (select event_id src, lag(event_id) over w dst, year - lag(year) over w time_diff from ev window w as (partition by series_id order by event_date, event_id)) where dst is not null)"


@query("count_events", f"{WITH}, f as (select * from ev where lower(sport) = '1-urgent' and year = 1998 and competitor_count >= 4) select (select count(*) from f) match_count, (select string_agg(name, '; ' order by name) from (select distinct name from f order by name limit 25)) listed")
def count_events(spark, folder):
    return toolkit.count_events(events(spark, folder), "more_than", 3, sport="1-Urgent", year=1998)


@query("event_aggregates", f"{WITH}, f as (select * from ev where lower(sport) = '2-high' and competitor_count between 2 and 6) select (select count(*) from f) match_count, (select count(distinct doc_id) from f) doc_count, (select string_agg(name, '; ' order by name) from (select distinct name from f order by name limit 25)) listed")
def event_aggregates(spark, folder):
    return graph.aggregates(events(spark, folder), sport="2-HIGH", least=2, most=6)


@query("count_events_bounds", f"{WITH} select sport, year, count(*) filter (competitor_count >= 5) more_than_4, count(*) filter (competitor_count >= 3) at_least_3, count(*) filter (competitor_count between 1 and 2) fewer_than_3, count(*) filter (competitor_count between 1 and 6) at_most_6, count(*) filter (competitor_count = 4) exactly_4, 0::bigint fewer_than_1 from ev group by sport, year")
def count_events_bounds(spark, folder):
    return toolkit.count_by_group(events(spark, folder), [("more_than", 4), ("at_least", 3), ("fewer_than", 3), ("at_most", 6), ("exactly", 4), ("fewer_than", 1)])


@query("preceding_event", f"{WITH}, {BACK} select a.name as event, b.name prior_event, b.year prior_year, b.gold_athlete, b.doc_id, src, dst, time_diff from ev a join pr on a.event_id = src join ev b on b.event_id = dst where a.year = 1998 and lower(a.sport) = '5-low' and lower(a.gender) = 'building' and contains(a.name, 'final 1')")
def preceding_event(spark, folder):
    all_events = events(spark, folder)
    return graph.preceding(all_events, graph.edges_back(all_events), sport="5-low", gender="Building", fragment="FINAL 1", year=1998)


@query("superlative_event", f"{WITH} select event_id, name, competitor_count, doc_id from ev where lower(sport) = '3-medium' and lower(season) = 'f' order by competitor_count desc, name, event_id limit 10")
def superlative_event(spark, folder):
    return graph.superlative(events(spark, folder), sport="3-medium", season="F", limit=10).select("event_id", "name", "competitor_count", "doc_id")


@query("fewest_competitors", f"{WITH} select event_id, name, competitor_count, doc_id from ev where year = 1999 order by competitor_count, name, event_id limit 10")
def fewest_competitors(spark, folder):
    return graph.superlative(events(spark, folder), year=1999, order="asc", limit=10).select("event_id", "name", "competitor_count", "doc_id")


@query("event_by_venue_date", f"{WITH}, f as (select event_id, name, gold_athlete, doc_id from ev where contains(lower(venue), 'nation_1') and contains(lower(start_date), '11 february') and year = 1998) select * from f where (select count(*) from f) <= 20")
def event_by_venue_date(spark, folder):
    return graph.at_venue_date(events(spark, folder), "NATION_1", "11 February 1998 (final)", 1998).select("event_id", "name", "gold_athlete", "doc_id")


@query("venue_relaxation", f"{WITH}, v(i, t) as (values (0, 'nation_3 central hall north wing'), (1, 'nation_3 central hall north'), (2, 'nation_3 central hall')), f as (select event_id, min(i) variant from ev, v where contains(lower(venue || ' central hall'), t) and contains(lower(start_date), '7 march') group by event_id), g as (select * from f where variant = (select min(variant) from f)) select * from g where (select count(*) from g) <= 20")
def venue_relaxation(spark, folder):
    halls = events(spark, folder).withColumn("venue", F.concat("venue", F.lit(" central hall")))
    return graph.at_venue_date(halls, "NATION_3 central hall north wing", "7 March", 0).select("event_id", "variant")


@query("event_attribute", f"{WITH} select event_id, name, case when competitor_count > 0 then competitor_count::varchar else '' end competitors, case when nation_count > 0 then nation_count::varchar else '' end nations, gold_athlete, venue, doc_id from ev where contains(name, 'final 17') and year = 2000 and lower(gender) = 'furniture'")
def event_attribute(spark, folder):
    found = graph.attributes(events(spark, folder), " final 17", year=2000, gender="furniture")
    return found.select("event_id", "name", toolkit.attribute_text("competitor_count").alias("competitors"), toolkit.attribute_text("nation_count").alias("nations"), "gold_athlete", "venue", "doc_id")


@query("vertices_by_id", f"{WITH} select pos, event_id, name from (select unnest([5, 3, 999999999, 8]) event_id, unnest([1, 2, 3, 4])::bigint pos) join ev using (event_id)")
def vertices_by_id(spark, folder):
    ids = spark.createDataFrame([(1, 5), (2, 3), (3, 999999999), (4, 8)], "pos long, event_id long")
    return graph.by_ids(events(spark, folder), ids, "event_id").select("pos", "event_id", "name")


@query("graph_counts", f"{WITH}, {BACK} select 'Event' kind, count(*) n from ev union all select 'PRECEDES', count(*) from pr union all select 'Venue', count(distinct venue) from ev union all select 'Document', count(*) from documents")
def graph_counts(spark, folder):
    all_events = events(spark, folder)
    one = lambda rows, kind: rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return one(all_events, "Event").unionByName(one(graph.edges_back(all_events), "PRECEDES")).unionByName(one(all_events.select("venue").where("venue is not null").distinct(), "Venue")).unionByName(one(table(spark, folder, "documents"), "Document"))


@query("event_documents", f"{WITH} select event_id, doc_id, lang, n_chars from ev left join documents using (doc_id) where year = 1996")
def event_documents(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang", "n_chars")
    return events(spark, folder).where("year = 1996").join(docs, "doc_id", "left").select("event_id", "doc_id", "lang", "n_chars")


@query("rank_with_ties", f"{WITH}, r as (select *, rank() over (partition by sport, year order by competitor_count desc) k from ev where competitor_count > 0) select sport, year, event_id, competitor_count, count(*) over (partition by sport, year) n_tied from r where k = 1")
def rank_with_ties(spark, folder):
    return toolkit.rank_events(events(spark, folder), ["sport", "year"]).select("sport", "year", "event_id", "competitor_count", "n_tied")


@query("previous_games_year", f"{WITH} select season, year, lag(year) over (partition by season order by year) previous_year from (select distinct season, year from ev where year > 0)")
def previous_games_year(spark, folder):
    return toolkit.previous_year(events(spark, folder))


@query("previous_edition", f"{WITH}, {BACK}, py as (select season, year, lag(year) over (partition by season order by year) previous_year from (select distinct season, year from ev where year > 0)) select a.event_id, b.name prior_event, b.gold_athlete winner, coalesce(b.year < previous_year, false) skipped from ev a join pr on src = a.event_id join ev b on dst = b.event_id left join py on a.season = py.season and a.year = py.year")
def previous_edition(spark, folder):
    all_events = events(spark, folder)
    return toolkit.previous_edition(all_events, graph.edges_back(all_events))


@query("chronology", f"{WITH} select event_id, lag(event_id) over w prev_event_id, lead(event_id) over w next_event_id, coalesce(year - lag(year) over w, lead(year) over w - year, 0) time_diff from ev window w as (partition by series_id order by year, event_date, event_id)")
def chronology(spark, folder):
    return graph.chronology(events(spark, folder))


@query("edition_links", f"{WITH}, {BACK} select src, dst, time_diff, 'PRECEDES' kind from pr union all select dst, src, time_diff, 'SUCCEEDS' from pr")
def edition_links(spark, folder):
    return graph.with_reverse(graph.edges_back(events(spark, folder)))


@query("vertex_merge", f"{WITH}, new as (select event_id, 'renamed ' || name as name, case when event_id % 2 = 0 then 'moved' end venue from ev where event_id % 10 = 0 union all select event_id + 100000000, name, venue from ev where event_id % 50 = 0) select coalesce(new.event_id, ev.event_id) event_id, coalesce(new.name, ev.name) as name, coalesce(new.venue, ev.venue) venue, ev.sport from ev full join new on ev.event_id = new.event_id")
def vertex_merge(spark, folder):
    stored = events(spark, folder).select("event_id", "name", "venue", "sport")
    changed = stored.where("event_id % 10 = 0").select("event_id", F.concat(F.lit("renamed "), "name").alias("name"), F.when(F.col("event_id") % 2 == 0, "moved").alias("venue"))
    added = stored.where("event_id % 50 = 0").select((F.col("event_id") + 100000000).alias("event_id"), "name", "venue")
    return graph.merge_vertices(stored, changed.unionByName(added), "event_id")


@query("edge_union", f"{WITH}, {BACK} select src, dst, min(time_diff) time_diff from (select * from pr union all select * from pr where src % 3 = 0) group by src, dst")
def edge_union(spark, folder):
    edges = graph.edges_back(events(spark, folder))
    return graph.add_edges(edges, edges.where("src % 3 = 0"), as_set=True)


@query("edge_append", f"{WITH}, {BACK} select src, count(*) n from (select * from pr union all select * from pr where src % 3 = 0) group by src")
def edge_append(spark, folder):
    edges = graph.edges_back(events(spark, folder))
    return graph.add_edges(edges, edges.where("src % 3 = 0")).groupBy("src").agg(F.count(F.lit(1)).alias("n"))


@query("last_write_wins", f"{WITH} select venue, arg_max(name, (event_date, event_id)) as name from ev group by venue")
def last_write_wins(spark, folder):
    return graph.last_written(events(spark, folder).withColumn("at", F.struct("event_date", "event_id")), "venue", "name", "at")


@query("semi_narrow", f"{WITH} select distinct name from ev where competitor_count >= 6 and name in (select name from ev where lower(season) = 'p' and lower(gender) = 'building')")
def semi_narrow(spark, folder):
    all_events = events(spark, folder)
    return toolkit.narrowed(all_events.where("competitor_count >= 6").select("name").distinct(), all_events, "p", "Building")


@query("anti_missing", "select doc_id from documents where doc_id not in (select vec_id from embeddings)")
def anti_missing(spark, folder):
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return table(spark, folder, "documents").select("doc_id").join(vectors, "doc_id", "left_anti")


@query("never_held", f"{WITH}, c as (select *, venue sport2 from ev where competitor_count >= 8) select season, year, sport from (select distinct season, year from c), (select distinct season s2, venue sport from c) where season = s2 except select season, year, venue from c")
def never_held(spark, folder):
    rare = events(spark, folder).where("competitor_count >= 8").select("season", "year", F.col("venue").alias("sport"))
    return toolkit.never_held(rare)


@query("moved_title", f"{WITH}, t as (select distinct name, season from ev), g as (select distinct season, year from ev) select name, t.season, min(g.year) as year from t join g on t.season = g.season where not exists (select 1 from ev where ev.name = t.name and ev.season = t.season and ev.year = g.year) group by name, t.season")
def moved_title(spark, folder):
    return toolkit.moved_titles(events(spark, folder))


@query("group_leaders", f"{WITH}, s as (select *, count(*) over (partition by venue, year) n, rank() over (partition by venue, year order by competitor_count desc) k from ev where competitor_count > 0), t as (select *, count(*) over (partition by venue, year) tied from s where k = 1 and n >= 4) select venue, year, event_id, competitor_count from t where tied = 1")
def group_leaders(spark, folder):
    return toolkit.leaders(events(spark, folder), ["venue", "year"]).select("venue", "year", "event_id", "competitor_count")


@query("seeded_sample", f"{WITH} select event_id, name from ev order by md5(event_id || '|' || 42), event_id limit 50")
def seeded_sample(spark, folder):
    return toolkit.seeded_sample(events(spark, folder), "event_id", 50, 42).select("event_id", "name")


@query("vocabulary_check", f"{WITH}, w(constraint_name, constraint_value) as (values ('sport', 'rowing'), ('sport', '5-Low'), ('year', '1912'), ('year', '1998'), ('season', 'f')) select * from w where not exists (select 1 from ev where (constraint_name = 'sport' and lower(sport) = lower(constraint_value)) or (constraint_name = 'year' and year::varchar = constraint_value) or (constraint_name = 'season' and lower(season) = lower(constraint_value)))")
def vocabulary_check(spark, folder):
    wanted = spark.createDataFrame([("sport", "rowing"), ("sport", "5-Low"), ("year", "1912"), ("year", "1998"), ("season", "f")], "constraint_name string, constraint_value string")
    return toolkit.unmatched(wanted, events(spark, folder), ["sport", "year", "season"])


@query("reconcile_diff", f"{WITH}, live as (select event_id, case when event_id % 11 = 0 then 'other' else name end as name, case when event_id % 13 <> 0 then competitor_count end competitor_count from ev where event_id % 17 <> 0) select e.event_id, u.* from ev e left join live l on e.event_id = l.event_id, lateral (select '(missing)' column_name, null::varchar expected, null::varchar actual where l.event_id is null union all select 'name', e.name, l.name where l.event_id is not null and e.name is distinct from l.name union all select 'competitor_count', e.competitor_count::varchar, l.competitor_count::varchar where l.event_id is not null and e.competitor_count is distinct from l.competitor_count) u")
def reconcile_diff(spark, folder):
    expected = events(spark, folder).select("event_id", "name", "competitor_count")
    live = expected.where("event_id % 17 <> 0").select("event_id", F.when(F.col("event_id") % 11 == 0, "other").otherwise(F.col("name")).alias("name"), F.when(F.col("event_id") % 13 != 0, F.col("competitor_count")).alias("competitor_count"))
    return graph.differences(expected, live, "event_id", ["name", "competitor_count"])


@query("graph_stats", f"{WITH} select count(*) events, count(distinct (season, year)) games, count(distinct sport) sports, count(distinct venue) venues, (select sum(n - 1) from (select count(*) n from ev group by series_id)) edition_links from ev")
def graph_stats(spark, folder):
    return views.stats(events(spark, folder))


@query("constellation", f"{WITH} select year || ' ' || season games, sport, count(*) events, round(1 + 2.2 * ln(1 + count(*)), 2) weight from ev group by year, season, sport")
def constellation(spark, folder):
    return views.constellation(events(spark, folder))


@query("venues_view", f"{WITH} select distinct venue, year || ' ' || season games from ev where venue is not null")
def venues_view(spark, folder):
    return views.venues(events(spark, folder))


@query("lineage", f"{WITH}, b as (select arg_max(sport, (n, sport)) sport from (select sport, count(*) n from ev group by sport)), l as (select event_id src, lead(event_id) over (partition by series_id order by year, event_date, event_id) dst from ev where sport = (select sport from b)) select * from l where dst is not null order by src, dst limit 400")
def lineage(spark, folder):
    return views.lineage(events(spark, folder))


@query("investigation", f"{WITH}, {BACK}, e as (select * from ev where event_id % 100 = 0), r as (select e.event_id, 'RIVAL' kind, o.event_id::varchar node, row_number() over (partition by e.event_id order by o.event_id) k from e join ev o on e.sport = o.sport and e.year = o.year and e.season = o.season and e.event_id <> o.event_id) select event_id, 'GAMES' kind, year || ' ' || season node from e union all select event_id, 'SPORT', sport from e union all select event_id, 'VENUE', venue from e where venue is not null union all select event_id, 'PREVIOUS', dst::varchar from e join pr on src = event_id union all select event_id, 'NEXT', src::varchar from e join pr on dst = event_id union all select event_id, kind, node from r where k <= 12")
def investigation(spark, folder):
    all_events = events(spark, folder)
    return views.investigation(all_events.where("event_id % 100 = 0"), all_events, graph.edges_back(all_events))


@query("view_nodes", f"{WITH} select node_id, arg_min(kind, priority) kind from (select sport node_id, 'sport' kind, 1 priority from ev union all select season, 'season', 2 from ev union all select venue, 'venue', 3 from ev where venue is not null union all select gender, 'gender', 4 from ev) group by node_id")
def view_nodes(spark, folder):
    rows = events(spark, folder)
    kinds = ["sport", "season", "venue", "gender"]
    nodes = [rows.where(F.col(k).isNotNull()).select(F.col(k).alias("node_id"), F.lit(k).alias("kind"), F.lit(i).alias("priority")).distinct() for i, k in enumerate(kinds)]
    return views.first_writer(nodes[0].unionByName(nodes[1]).unionByName(nodes[2]).unionByName(nodes[3]), ["node_id"], "priority").drop("priority")


@query("adjacency", f"{WITH}, {BACK}, b as (select src node, dst other from pr union all select dst, src from pr) select node, string_agg(other::varchar, ',' order by other) neighbours from b group by node")
def adjacency(spark, folder):
    return views.adjacency(graph.edges_back(events(spark, folder)))


@query("running_titles", f"{WITH} select event_id, count(*) over (partition by gold_athlete order by event_date, event_id rows unbounded preceding) titles from ev")
def running_titles(spark, folder):
    return events(spark, folder).select("event_id", F.count(F.lit(1)).over(W.partitionBy("gold_athlete").orderBy("event_date", "event_id").rowsBetween(W.unboundedPreceding, 0)).alias("titles"))


@query("catalog_load", f"{WITH} select event_id, name, case when event_id % 5 = 0 then '' when event_id % 5 < 3 then 'moved to ' || start_date else start_date end start_date from ev")
def catalog_load(spark, folder):
    """A fifth of the events has no edge, two fifths have a second one that is later."""
    rows = events(spark, folder, counted=False)
    first = rows.where("event_id % 5 > 0").select("event_id", F.lit(0).alias("seq"), "start_date")
    second = rows.where("event_id % 5 between 1 and 2").select("event_id", F.lit(1).alias("seq"), F.concat(F.lit("moved to "), "start_date").alias("start_date"))
    return graph.catalog(rows.select("event_id", "name"), second.unionByName(first))


@query("sql_count_events", f"{WITH} select sport, year, count(*) filter (competitor_count > 40) n from ev group by sport, year")
def sql_count_events(spark, folder):
    tools.register(events(spark, folder))
    return spark.sql("select * from count_events(40)")


@query("sql_leading_events", f"{WITH}, r as (select *, rank() over (partition by sport, year order by competitor_count desc) k from ev where competitor_count > 0) select sport, year, event_id, competitor_count, count(*) over (partition by sport, year) n_tied from r where k = 1")
def sql_leading_events(spark, folder):
    tools.register(events(spark, folder))
    return spark.sql("select * from leading_events(true)")


@query("batch_assign", f"{WITH} select event_id, (row_number() over (order by event_id) - 1) // 500 batch from ev")
def batch_assign(spark, folder):
    return views.batches(events(spark, folder).select("event_id"), "event_id", 500)
