"""Registered queries over facts, intervals and the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventgraph.operators import bitemporal, setjoin
from eventgraph.plans.proxy import EVENTS, FACTS, events, facts
from eventgraph.plans.registry import query
from eventgraph.session import table
from eventgraph.streaming import limits, windows

WITH = f"with {EVENTS}"
RESOLVED = f"""{FACTS},
o as (select *, row_number() over (partition by subject, predicate order by source_authority desc nulls last, valid_from desc nulls last, valid_to desc nulls last, fact_id) k from fa),
p as (select a.subject, a.predicate, a.fact_id ai, a.value av, a.source_authority aa, a.valid_from af, b.fact_id bi, b.value bv, b.source_authority ba, b.valid_from bf from o a left join o b on a.subject = b.subject and a.predicate = b.predicate and b.k = 2 where a.k = 1),
r as (select *, case when bi is null then 'single' when av is not distinct from bv then 'no_conflict' when abs(aa - ba) > 1e-4 then 'authority' when af is distinct from bf then 'valid_from_timestamp' else 'unresolved_tie' end reason from p),
w as (select *, case when reason in ('single', 'no_conflict', 'authority') then ai when reason = 'valid_from_timestamp' then case when bf is null or af > bf then ai else bi end end winner,
  case when reason in ('single', 'no_conflict', 'authority') then av when reason = 'valid_from_timestamp' then case when bf is null or af > bf then av else bv end end wv from r)"""


@query("resolve_conflicts", f"with {RESOLVED} select w.subject, w.predicate, reason, winner, (select count(*) from fa where fa.subject = w.subject and fa.predicate = w.predicate) n_facts, (select count(distinct value) from fa where fa.subject = w.subject and fa.predicate = w.predicate) n_values, case when reason in ('authority', 'valid_from_timestamp') then (select count(*) from fa where fa.subject = w.subject and fa.predicate = w.predicate and value <> wv) else 0 end n_superseded from w")
def resolve_conflicts(spark, folder):
    return bitemporal.resolve(facts(spark, folder))


@query("conflict_edges", f"with {RESOLVED} select fact_id::varchar src, winner::varchar dst, w.predicate conflict_type, reason resolution from w join fa on fa.subject = w.subject and fa.predicate = w.predicate where reason in ('authority', 'valid_from_timestamp') and value <> wv and fact_id <> winner")
def conflict_edges(spark, folder):
    rows = facts(spark, folder)
    return bitemporal.conflict_edges(rows, bitemporal.resolve(rows))


@query("confidence_interval", f"with {FACTS}, c as (select fact_id, least(greatest(source_authority, 0.05), 1.0) a, least(greatest(confidence, 0.05), 1.0) c from fa), p as (select *, least(greatest(a * c, 0.05), 0.99)::double p from c), m as (select *, least(greatest(1.96 * sqrt(p * (1 - p)) + 0.15 * (1 - a), 0.04), 0.35)::double m from p) select fact_id, round_even(greatest(p - m, 0.0), 3) low, round_even(least(p + m, 1.0), 3) high from m")
def confidence_interval(spark, folder):
    return facts(spark, folder).select("fact_id", bitemporal.confidence_interval(F.col("source_authority"), F.col("confidence")).alias("c")).select("fact_id", "c.*")


@query("valid_at", f"with {FACTS} select fact_id, coalesce(valid_from <= timestamp '2024-01-10 12:00:00', true) valid from fa")
def valid_at(spark, folder):
    return facts(spark, folder).select("fact_id", bitemporal.valid_at(F.lit("2024-01-10 12:00:00").cast("timestamp_ntz")).alias("valid"))


@query("unpivot_facts", f"{WITH} select event_id, predicate, value from (select event_id, unnest(['name', 'venue', 'competitor_count', 'gold_athlete']) predicate, unnest([name, venue, nullif(competitor_count, 0)::varchar, gold_athlete]) as value from ev) where value is not null and value <> ''")
def unpivot_facts(spark, folder):
    rows = events(spark, folder).withColumn("competitor_count", F.nullif("competitor_count", F.lit(0)))
    return bitemporal.unpivoted(rows, "event_id", ["name", "venue", "competitor_count", "gold_athlete"])


@query("interval_overlap", "with o as (select o_orderkey, o_custkey, o_orderdate f, o_orderdate + interval 30 day t from orders) select a.o_orderkey a, b.o_orderkey b from o a join o b on a.o_custkey = b.o_custkey and a.o_orderkey < b.o_orderkey and a.f <= b.t and b.f <= a.t")
def interval_overlap(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("f"), (F.col("o_orderdate") + F.expr("interval 30 days")).alias("t"))
    pairs = setjoin.overlapping(orders, orders, ["o_custkey"], 30 * 86400, "f", "t")
    return pairs.where("left.o_orderkey < right.o_orderkey").select(F.col("left.o_orderkey").alias("a"), F.col("right.o_orderkey").alias("b"))


@query("version_conflicts", f"{WITH}, v as (select event_id, predicate, value from (select event_id, unnest(['name', 'venue', 'gender']) predicate, unnest([name, venue, gender]) as value from ev)) select a.event_id subject, predicate, a.value value_a, case when a.event_id % 4 = 0 then 'other' else a.value end value_b from v a where a.value is not null and a.event_id % 4 = 0 and a.value <> 'other'")
def version_conflicts(spark, folder):
    long = bitemporal.unpivoted(events(spark, folder), "event_id", ["name", "venue", "gender"]).withColumnRenamed("event_id", "subject")
    changed = long.withColumn("value", F.when(F.col("subject") % 4 == 0, "other").otherwise(F.col("value")))
    return bitemporal.conflicting_pairs(long, changed)


@query("time_parsing", "select event_id, ts::timestamp parsed_iso, make_timestamp(year(ts), 1, 1, 0, 0, 0) parsed_year, to_timestamp(epoch(date_trunc('day', ts))::bigint)::timestamp parsed_epoch, make_timestamp(1800 + event_id % 400, 1, 1, 0, 0, 0) year_number, to_timestamp(event_id % 1800)::timestamp small_number, null::timestamp parsed_bad from (select event_id, date_trunc('second', ts) ts from events)")
def time_parsing(spark, folder):
    rows = table(spark, folder, "events").select("event_id", F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"))
    iso, year, epoch = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format("ts", "yyyy"), F.unix_timestamp(F.date_trunc("day", "ts"))
    texts = {"parsed_iso": iso, "parsed_year": year, "parsed_bad": F.lit("no date")}
    numbers = {"parsed_epoch": epoch, "year_number": 1800 + F.col("event_id") % 400, "small_number": F.col("event_id") % 1800}
    return rows.select("event_id", *[bitemporal.parse_time(c).alias(n) for n, c in texts.items()], *[bitemporal.time_of_number(c).alias(n) for n, c in numbers.items()])


@query("superseded_facts", f"with {RESOLVED} select fact_id, case when reason in ('authority', 'valid_from_timestamp') and value is distinct from wv then winner end superseded_by from fa left join w on fa.subject = w.subject and fa.predicate = w.predicate")
def superseded_facts(spark, folder):
    rows = facts(spark, folder)
    return bitemporal.superseded(rows, bitemporal.resolve(rows)).select("fact_id", "superseded_by")


@query("strategy_shifts", f"with {RESOLVED}, l as (select w.subject, w.predicate, list_sort(list(fact_id::varchar)) ids from w join fa on fa.subject = w.subject and fa.predicate = w.predicate where reason in ('authority', 'valid_from_timestamp') and value is distinct from wv group by all) select w.subject, w.predicate, reason <> 'no_conflict' changed, reason resolved_by, winner::varchar winner_fact_id, coalesce(len(ids), 0)::int n_superseded from w left join l using (subject, predicate) where reason <> 'single'")
def strategy_shifts(spark, folder):
    rows = facts(spark, folder)
    resolved = bitemporal.resolve(rows)
    told = bitemporal.strategy_shifts(bitemporal.superseded(rows, resolved), resolved)
    event = F.from_json("event", "resolved_by string, winner_fact_id string, superseded_fact_ids array<string>")
    return told.select("subject", "predicate", "changed", event.alias("e")).select("subject", "predicate", "changed", "e.resolved_by", "e.winner_fact_id", F.size("e.superseded_fact_ids").alias("n_superseded"))


@query("tumbling", "select time_bucket(interval '1 hour', ts) window_start, time_bucket(interval '1 hour', ts) + interval 1 hour window_end, event_type, count(*) n, round(sum(value), 6) total from events group by all")
def tumbling(spark, folder):
    return windows.tumbling(table(spark, folder, "events"), "1 hour", ["event_type"])


@query("sliding", "with w as (select time_bucket(interval '30 minutes', ts) - interval '30 minutes' * k s, * from events, (select unnest([0, 1]) k)) select s window_start, s + interval 1 hour window_end, event_type, count(*) n, round(sum(value), 6) total from w group by all")
def sliding(spark, folder):
    return windows.sliding(table(spark, folder, "events"), "1 hour", "30 minutes", ["event_type"])


@query("session", "with g as (select *, case when ts - lag(ts) over w < interval '30 minutes' then 0 else 1 end fresh from events window w as (partition by user_id order by ts)), s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) k from g) select min(ts) window_start, max(ts) + interval '30 minutes' window_end, user_id, count(*) n, round(sum(value), 6) total from s group by user_id, k")
def session(spark, folder):
    return windows.sessions(table(spark, folder, "events"), "30 minutes", ["user_id"])


@query("first_write_wins", "select user_id, min(ts) ts, arg_min(event_id, ts) event_id from events group by user_id")
def first_write_wins(spark, folder):
    return windows.first_per_key(table(spark, folder, "events").select("user_id", "ts", "event_id"), "user_id")


#: All requests one after the other; the day's cap is one for all users.
RATE = """
with recursive q as (select event_id id, user_id client, epoch_us(ts) / 1e6 as tm, row_number() over (order by ts, event_id) n from events),
w as (select 0::bigint n, null::bigint id, null::bigint client, null::boolean accepted, -1::bigint as day, 0::bigint used, []::struct(c bigint, t double)[] recent
  union all
  select n2, id2, c2, ok, d2, case when d2 = day then used else 0 end + ok::int, case when ok then list_append(kept, {'c': c2, 't': tm}) else kept end from (
    select q.n n2, q.id id2, q.client c2, floor(q.tm / 86400)::bigint d2, w.day, w.used, q.tm, list_filter(w.recent, lambda x: x.t > q.tm - 3600) kept,
      len(list_filter(w.recent, lambda x: x.c = q.client and x.t > q.tm - 3600)) < 1 and (case when floor(q.tm / 86400)::bigint = w.day then w.used else 0 end) < 300 ok
    from w join q on q.n = w.n + 1))
select id request_id, client, accepted from w where n > 0"""


@query("rate_cap", RATE)
def rate_cap(spark, folder):
    """At most one accepted request of a user in an hour and 300 of all in a day: the data are too sparse for the hour's default."""
    return limits.capped(requests(spark, folder), 1, 300)


def requests(spark, folder):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, folder, "events").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("client"), at.alias("at"))


@query("recent_requests", "select event_id, ts from events order by ts desc, event_id desc limit 25")
def recent_requests(spark, folder):
    return table(spark, folder, "events").select("event_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(25)
