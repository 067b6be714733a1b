"""Registered queries over the steps of runs, grounding and reports; conversations stand in for runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventgraph.operators import agent
from eventgraph.plans.metric_queries import KEY
from eventgraph.plans.proxy import EVENTS, events
from eventgraph.plans.registry import query
from eventgraph.session import table

WITH = f"with {EVENTS}"
STEPS = "st as (select conv_id run_id, turn step, split_part(text, ' ', 1) tool, case turn % 3 when 0 then 'failed' when 1 then 'ok' else 'ambiguous' end status, case when role = 'user' then 'plan' else 'observation' end kind, text from conversations)"


def steps(spark, folder):
    status = F.when(F.col("turn") % 3 == 0, "failed").when(F.col("turn") % 3 == 1, "ok").otherwise("ambiguous")
    return table(spark, folder, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("step"), F.split_part("text", F.lit(" "), F.lit(1)).alias("tool"), status.alias("status"), F.when(F.col("role") == "user", "plan").otherwise("observation").alias("kind"), "text")


@query("strategy_changes", f"with {STEPS} select run_id, step, coalesce(lag(status) over w in ('failed', 'ambiguous') and lag(tool) over w <> tool, false) changed from st window w as (partition by run_id order by step)")
def strategy_changes(spark, folder):
    return agent.strategy_changes(steps(spark, folder)).select("run_id", "step", "changed")


@query("plan_pairs", f"with {STEPS} select run_id, step, md5(plan) plan_md5 from (select *, last_value(case when kind = 'plan' then text end ignore nulls) over (partition by run_id order by step rows unbounded preceding) plan from st) where kind = 'observation'")
def plan_pairs(spark, folder):
    return agent.paired(steps(spark, folder)).select("run_id", "step", F.md5(F.col("plan").cast("binary")).alias("plan_md5"))


@query("fan_out", f"{WITH}, r as (select *, rank() over (partition by sport, season order by competitor_count desc) k from ev where competitor_count > 0), t as (select sport || season question_id, venue, min(event_id) p from r where k = 1 and venue is not null group by 1, 2) select question_id, string_agg(venue, '; ' order by p) answer from t group by question_id")
def fan_out(spark, folder):
    """Rank, then an attribute of all winners, in one plan."""
    from eventgraph.operators import toolkit

    tied = toolkit.rank_events(events(spark, folder), ["sport", "season"]).select(F.concat("sport", "season").alias("question_id"), "event_id", F.col("event_id").alias("position"))
    return agent.fan_out(tied, events(spark, folder).select("event_id", F.col("venue").alias("value")))


@query("evidence_lines", "with w as (select doc_id, string_split(text, chr(10)) l, split_part(string_split(text, chr(10))[2], ' ', 2) v from documents where contains(text, chr(10))), f as (select doc_id, l, " + "trim(regexp_replace(replace(replace(lower(regexp_replace(strip_accents({t}), '[^\\x00-\\x7F]', '', 'g')), '''', ''), '+', ' plus '), '[^a-z0-9]+', ' ', 'g'))".format(t="v") + " fv from w) select doc_id question_id, md5(list_filter(l, lambda x: contains(" + "trim(regexp_replace(replace(replace(lower(regexp_replace(strip_accents({t}), '[^\\x00-\\x7F]', '', 'g')), '''', ''), '+', ' plus '), '[^a-z0-9]+', ' ', 'g'))".format(t="x") + ", fv))[1]) line_md5 from f where fv <> '' and not list_bool_or(list_transform(l, lambda x: contains(x, ' | ')))")
def evidence_lines(spark, folder):
    docs = table(spark, folder, "documents").where(F.contains("text", F.lit("\n")))
    lines = F.split("text", "\n")
    plain = ~F.exists(lines, lambda x: F.contains(x, F.lit(" | ")))
    wanted = docs.where(plain).select(F.col("doc_id").alias("question_id"), "doc_id", F.lit(1).alias("position"), F.split_part(F.get(lines, F.lit(1)), F.lit(" "), F.lit(2)).alias("value"))
    found = agent.evidence(docs.select("doc_id", F.lit(0).alias("chunk_index"), "text"), wanted)
    return found.select("question_id", F.md5(F.col("line").cast("binary")).alias("line_md5"))


GROUND = f"an as (select doc_id, split_part(text, ' ', 3) || case when doc_id % 4 = 0 then '; zzzz' else '' end answer, [string_split(text, chr(10))[1]] passages from documents where text is not null)"


@query("grounded_answers", f"with {GROUND} select doc_id, len(ps) > 0 and list_bool_and(list_transform(ps, lambda p: not regexp_full_match({KEY.format(t='p')}, '[0-9]*') and contains({KEY.format(t='passages[1]')}, {KEY.format(t='p')}))) grounded from (select *, list_filter(list_transform(string_split(answer, ';'), lambda p: trim(p)), lambda p: p <> '') ps from an) where len(ps) > 0")
def grounded_answers(spark, folder):
    docs = table(spark, folder, "documents").where("text is not null")
    answer = F.concat(F.split_part("text", F.lit(" "), F.lit(3)), F.when(F.col("doc_id") % 4 == 0, "; zzzz").otherwise(""))
    rows = docs.select("doc_id", answer.alias("answer"), F.array(F.get(F.split("text", "\n"), F.lit(0))).alias("passages"), F.lit(None).cast("string").alias("verified"), F.lit(False).alias("asks_year"))
    return rows.where(F.regexp_replace("answer", "[;\\s]", "") != "").select("doc_id", agent.grounded("answer", "verified", "passages", "asks_year").alias("grounded"))


@query("moved_years", f"{WITH} select event_id, array_to_string(case when event_id % 3 = 0 then [(year + 4)::varchar] else []::varchar[] end, ',') moved from ev")
def moved_years(spark, folder):
    year = F.col("year").cast("string")
    argument = F.concat(F.lit("venue at "), year, F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" or "), (F.col("year") + 4).cast("string"))).otherwise(""))
    return events(spark, folder).select("event_id", F.array_join(agent.moved_years(F.concat(F.lit("Who won in "), year, F.lit("?")), argument), ",").alias("moved"))


@query("lanes", "with a as (select event_id qid, event_type answer from events where event_id % 2 = 0), b as (select event_id qid, props answer from events where event_id % 3 = 0), c as (select event_id qid, user_id::varchar answer from events where event_id % 5 <> 0) select qid, a.answer rag, b.answer graph, c.answer agentic from a full join b using (qid) full join c using (qid)")
def lanes(spark, folder):
    rows = table(spark, folder, "events").withColumnRenamed("event_id", "qid")
    lane = lambda condition, column: rows.where(condition).select("qid", F.col(column).cast("string").alias("answer"))
    return agent.side_by_side({"rag": lane("qid % 2 = 0", "event_type"), "graph": lane("qid % 3 = 0", "props"), "agentic": lane("qid % 5 <> 0", "user_id")})


@query("citations", "with r as (select user_id qid, event_id % 3 lane, case when value < 3 then 'Not found in corpus.' else event_type end answer, [event_id % 7, event_id % 5, event_id % 7] doc_ids from events), g as (select qid, lane, unnest(doc_ids) doc_id, generate_subscripts(doc_ids, 1) i from r where not regexp_matches(answer, '(?i)^not found in corpus\\.?$')), f as (select qid, doc_id, min((lane, i)) k from g group by all) select qid, doc_id, row_number() over (partition by qid order by k, doc_id)::int n from f")
def citations(spark, folder):
    rows = table(spark, folder, "events")
    results = rows.select(F.col("user_id").alias("qid"), (F.col("event_id") % 3).alias("lane"), F.when(F.col("value") < 3, "Not found in corpus.").otherwise(F.col("event_type")).alias("answer"), F.array(F.col("event_id") % 7, F.col("event_id") % 5, F.col("event_id") % 7).alias("doc_ids"))
    return agent.cited(results).withColumnRenamed("at", "n")


@query("event_candidates", f"{WITH}, g as (select series_id, list({{'n': name, 'c': competitor_count}} order by event_id) l from ev group by series_id), x as (select series_id, unnest(l[:10]) e, generate_subscripts(l[:10], 1) pos from g) select series_id, (pos - 1)::int as pos, e.n as name, case when e.c > 0 then e.c end competitor_count from x")
def event_candidates(spark, folder):
    """Replies that nest a series' events two objects deep."""
    count = F.when(F.col("competitor_count") > 0, F.col("competitor_count"))
    event = F.struct(F.lit("Event").alias("v_type"), F.struct(F.col("name").alias("Events.name"), count.alias("competitor_count")).alias("attributes"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("event_id", event.alias("e")))), lambda x: x["e"])
    replies = events(spark, folder).groupBy("series_id").agg(F.to_json(F.struct(F.struct(ordered.alias("Events")).alias("results"))).alias("reply"))
    return agent.event_candidates(replies, key="series_id")


@query("tool_arguments", "select event_id, case when event_id % 2 = 0 then event_type end event, case when event_id % 3 = 0 then (user_id)::varchar end as year, 'colour' unsupported from events")
def tool_arguments(spark, folder):
    given = F.create_map(F.lit("event_name"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" "), "event_type")).otherwise(""), F.lit("target_year"), F.when(F.col("event_id") % 3 == 0, F.col("user_id").cast("string")).otherwise("about 1990"), F.lit("colour"), F.lit("red"))
    known = ("event", "year")
    clean = table(spark, folder, "events").select("event_id", agent.tool_arguments(given, known).alias("a"), F.array_join(agent.unsupported_arguments(given, known), ",").alias("unsupported"))
    return clean.select("event_id", F.try_element_at("a", F.lit("event")).alias("event"), F.try_element_at("a", F.lit("year")).alias("year"), "unsupported")


@query("batch_rows", "select event_id qid, 'rag' pipeline, event_type answer from events where event_id % 2 = 0 union all select event_id, 'graph', props from events where event_id % 3 = 0")
def batch_rows(spark, folder):
    rows = table(spark, folder, "events").withColumnRenamed("event_id", "qid")
    lanes = {"rag": rows.where("qid % 2 = 0").withColumnRenamed("event_type", "answer"), "graph": rows.where("qid % 3 = 0").withColumnRenamed("props", "answer"), "agentic": rows.withColumnRenamed("props", "answer")}
    return agent.batch_rows(lanes, ["rag", "graph"])


@query("asked_kinds", "select event_id, case event_id % 5 when 0 then 'event' when 1 then 'person' when 2 then 'number' when 3 then 'venue' end kind from events")
def asked_kinds(spark, folder):
    texts = ["Which {} event had most competitors?", "Who won in {}?", "How many nations took part in {}?", "In what arena was {} held?", "What of {} then?"]
    text = F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, folder, "events").select("event_id", agent.asked_kind(F.replace(text, F.lit("{}"), F.col("event_type"))).alias("kind"))


@query("backend_states", "select event_id, event_id % 4 in (0, 1) unavailable, case when event_id % 3 = 0 then 'chat' else 'ask' end intent from events")
def backend_states(spark, folder):
    message = F.element_at(F.array(*[F.lit(t) for t in ("HTTP status 503", "Request Timed Out", "no such event", "connection refused")]), (F.col("event_id") % 4 + 1).cast("int"))
    reply = F.element_at(F.array(F.lit(" chat."), F.lit("ASK"), F.lit(None).cast("string")), (F.col("event_id") % 3 + 1).cast("int"))
    return table(spark, folder, "events").select("event_id", agent.unavailable(message).alias("unavailable"), agent.intent(reply).alias("intent"))


@query("evidence_block", "with r as (select event_type pipeline, event_id % 4 k, user_id % 2 = 0 known from events) select pipeline, count(*) filter (k = 0) abstained, count(*) filter (k = 1 and known) gold_among, count(*) filter (k in (1, 3) and known) grounded, count(*) filter (k in (1, 3)) groundable from r group by pipeline")
def evidence_block(spark, folder):
    answer = F.element_at(F.array(F.lit("Not found in corpus."), F.lit("Bo; Ada Berg"), F.lit("1,234"), F.lit("Bo")), (F.col("event_id") % 4 + 1).cast("int"))
    known = F.col("user_id") % 2 == 0
    rows = table(spark, folder, "events").select(F.col("event_type").alias("pipeline"), answer.alias("answer"), F.when(known, "ada berg!").otherwise("x").alias("gold"), F.when(known, F.array(F.lit("Åda Berg and Bo won."), F.lit("t"))).otherwise(F.array(F.lit("nothing"))).alias("passages"))
    return agent.evidence_block(rows)


@query("call_keys", "select count(distinct (event_type, user_id))::bigint n_keys from events")
def call_keys(spark, folder):
    """Keys of repeated calls do not depend on the order of the arguments."""
    from eventgraph.operators import guard

    one = F.create_map(F.lit("type"), "event_type", F.lit("user"), F.col("user_id").cast("string"))
    other = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("type"), "event_type")
    keyed = table(spark, folder, "events").select(guard.call_key("count", F.when(F.col("event_id") % 2 == 0, one).otherwise(other)).alias("k"))
    return keyed.agg(F.count_distinct("k").alias("n_keys"))
