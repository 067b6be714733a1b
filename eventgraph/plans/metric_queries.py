"""Registered queries for metrics over rankings, answers and pipeline results."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventgraph.functions import text as tx
from eventgraph.operators import metrics, retrieval
from eventgraph.operators.ordering import settled
from eventgraph.plans.registry import query
from eventgraph.plans.text_queries import BM25, COMPACT, COSINE, TOKENS, asked, corpus, near
from eventgraph.session import table

RANKED = f"{COSINE}, ra as (select query_id, id, rank from ct where rank <= 10), go as (select a.vec_id query_id, b.vec_id id from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id where a.vec_id % 100 = 0)"
MARKED = f"{RANKED}, ma as (select ra.*, (go.id is not null)::int hit from ra left join go using (query_id, id)), ng as (select query_id, count(*) n_gold from go group by query_id)"


def labelled(spark, folder):
    """(vec_id, label), and the same of the vectors that ask."""
    labels = table(spark, folder, "embeddings").select("vec_id", "label").where("label is not null").distinct()
    return labels, labels.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")


def rankings(spark, folder):
    """Ten neighbours of each vector whose id is divisible by 100; those of them that are its label mates, the golds, and how many golds there are."""
    labels, left = labelled(spark, folder)
    ranked = settled(near(spark, folder, 10).select("query_id", "id", "rank"))
    mates = ranked.select("query_id", "id").join(left, "query_id").join(labels.withColumnRenamed("vec_id", "id"), ["id", "label"])
    counted = labels.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("n_gold")).where("n_gold > 0")
    return ranked, mates.where("query_id <> id").select("query_id", "id"), left.join(counted, "label").select("query_id", "n_gold")


IR = f"""with {MARKED}, cu as (select *, sum(hit) over (partition by query_id order by rank) / rank pr from ma)
select query_id, coalesce(min(case when hit = 1 then rank end) = 1, false)::int hit_1, coalesce(min(case when hit = 1 then rank end) <= 5, false)::int hit_5, round(coalesce(1.0 / min(case when hit = 1 then rank end), 0), 6) mrr,
 round(sum(case when rank <= 5 then hit else 0 end) / any_value(n_gold), 6) recall_5, round(sum(case when rank <= 5 then hit else 0 end) / count(*) filter (rank <= 5), 6) precision_5,
 round(sum(case when rank <= 5 then hit / log2(rank + 1) else 0 end) / (select sum(1 / log2(i + 1)) from range(1, 6) t(i) where i <= any_value(n_gold)), 6) ndcg_5, round(sum(case when rank <= 5 then hit * pr else 0 end) / least(any_value(n_gold), 5), 6) context_precision
from cu join ng using (query_id) group by query_id"""
IR = IR.replace("(select sum(1 / log2(i + 1)) from range(1, 6) t(i) where i <= any_value(n_gold))", "list_sum(list_transform(range(1, least(any_value(n_gold), 5) + 1), lambda i: 1 / log2(i + 1)))")


@query("retrieval_metrics", IR)
def retrieval_metrics(spark, folder):
    return metrics.retrieval(*rankings(spark, folder))


def part_of(name: str) -> None:
    """One measure of the retrieval metrics as its own query."""

    @query(name, f"with m as ({IR}) select query_id, {name} from m")
    def one(spark, folder):
        return metrics.retrieval(*rankings(spark, folder)).select("query_id", name)


for _measure in ("mrr", "ndcg_5", "context_precision"):
    part_of(_measure)


@query("recall_precision_at_k", f"with m as ({IR}) select query_id, recall_5, precision_5 from m")
def recall_precision_at_k(spark, folder):
    return metrics.retrieval(*rankings(spark, folder)).select("query_id", "recall_5", "precision_5")


@query("retrieval_cutoffs", f"with {MARKED}, pe as (select query_id, any_value(n_gold) g, min(case when hit = 1 then rank end) f, " + ", ".join(f"coalesce(sum(case when rank <= {k} then hit end), 0) h{k}" for k in (1, 5, 10)) + " from ng left join ma using (query_id) group by query_id) select " + ", ".join(f"round(avg(coalesce(f <= {k}, false)::int), 6) hit_{k}, round(avg(h{k} / g), 6) recall_{k}, round(avg(case when f <= {k} then 1.0 / f else 0 end), 6) mrr_{k}" for k in (1, 5, 10)) + " from pe")
def retrieval_cutoffs(spark, folder):
    ranked, gold, sizes = rankings(spark, folder)
    return metrics.cutoffs(ranked, gold, (1, 5, 10), sizes)


LINES = "an as (select doc_id qid, string_split(text, chr(10))[1] prediction, list_filter([string_split(text, chr(10))[2], lower(string_split(text, chr(10))[1])], lambda g: g is not null) golds from documents where contains(text, chr(10)))"
KEY = "regexp_replace(lower(strip_accents({t})), '[^a-z0-9]+', '', 'g')"


def answers(spark, folder):
    """First lines as answers; second lines and the first in small letters as golds."""
    lines = F.split("text", "\n")
    docs = table(spark, folder, "documents").where(F.contains("text", F.lit("\n")))
    golds = F.filter(F.array(F.get(lines, F.lit(1)), F.lower(F.get(lines, F.lit(0)))), lambda g: g.isNotNull())
    return docs.select(F.col("doc_id").alias("qid"), F.get(lines, F.lit(0)).alias("prediction"), golds.alias("golds"))


@query("exact_match", f"with {LINES} select qid, case when {KEY.format(t='prediction')} = '' then 0 else list_contains(list_transform(golds, lambda g: {KEY.format(t='g')}), {KEY.format(t='prediction')})::int end em, case when trim(prediction) = '' then 0 else list_contains(list_transform(golds, lambda g: trim(g)), trim(prediction))::int end strict from an")
def exact_match(spark, folder):
    return answers(spark, folder).select("qid", metrics.exact_match("prediction", "golds").alias("em"), metrics.strict_match("prediction", "golds").alias("strict"))


@query("token_f1", f"with {LINES.replace(', lower(string_split(text, chr(10))[1])', '')}, pt as (select qid, token, count(*) a from (select qid, unnest({TOKENS.format(t='prediction')}) token from an) group by all), gt as (select qid, token, count(*) b from (select qid, unnest({TOKENS.format(t='golds[1]')}) token from an) group by all), c as (select qid, sum(least(a, b)) c from pt join gt using (qid, token) group by qid) select qid, round(coalesce(2.0 * c / (len({TOKENS.format(t='prediction')}) + len({TOKENS.format(t='golds[1]')})), 0), 6) f1 from an left join c using (qid)")
def token_f1(spark, folder):
    return metrics.token_f1(answers(spark, folder).withColumn("golds", F.slice("golds", 1, 1)))


RESULTS = "re as (select event_id qid, event_type pipeline, 'type ' || (user_id % 4) qtype, (value > 20)::int correct, (props->>'k')::int * 10 input_tokens, user_id output_tokens, value latency from events)"


def results(spark, folder):
    """Stream rows as scored answers of pipelines."""
    rows = table(spark, folder, "events")
    tokens = F.try_variant_get(F.try_parse_json("props"), "$.k", "int") * 10
    return rows.select(F.col("event_id").alias("qid"), F.col("event_type").alias("pipeline"), F.concat(F.lit("type "), (F.col("user_id") % 4).cast("string")).alias("qtype"), (F.col("value") > 20).cast("int").alias("correct"), tokens.alias("input_tokens"), F.col("user_id").alias("output_tokens"), F.col("value").alias("latency"))


WILSON = "round_even(greatest((c / n + 3.8416 / (2 * n) - 1.96 * sqrt(c / n * (1 - c / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 0.0), 4) low, round_even(least((c / n + 3.8416 / (2 * n) + 1.96 * sqrt(c / n * (1 - c / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 1.0), 4) high"


@query("summary_by_type", f"with {RESULTS}, s as (select pipeline, qtype, count(*)::double n, sum(correct)::double c, round(avg(latency), 6) mean_latency, round(avg(input_tokens + output_tokens), 6) mean_tokens, round(100 * (2.5 * avg(input_tokens) + 10 * avg(output_tokens)) / 1e6, 6) cost_per_100 from re group by grouping sets ((pipeline, qtype), (pipeline))) select pipeline, qtype, n::bigint n, c::bigint correct, mean_latency, mean_tokens, cost_per_100, {WILSON} from s")
def summary_by_type(spark, folder):
    return metrics.summary(results(spark, folder))


@query("overall_block", f"with {RESULTS}, o as (select *, case when correct = 1 then 1.0 else (input_tokens % 10) / 10.0 end f1, row_number() over (partition by pipeline order by latency nulls last) k, count(latency) over (partition by pipeline) m from re), s as (select pipeline, count(*)::double n, sum(correct)::double c, round(avg(f1), 6) mean_f1, round(avg(input_tokens + output_tokens), 6) mean_tokens, round(100 * (2.5 * avg(input_tokens) + 10 * avg(output_tokens)) / 1e6, 6) cost_per_100, max(case when k = round_even(0.5 * (m - 1), 0) + 1 then latency end) latency_p50, max(case when k = round_even(0.95 * (m - 1), 0) + 1 then latency end) latency_p95 from o group by pipeline) select pipeline, n::bigint n, c::bigint correct, mean_f1, mean_tokens, cost_per_100, latency_p50, latency_p95, {WILSON} from s")
def overall_block(spark, folder):
    f1 = F.when(F.col("correct") == 1, 1.0).otherwise((F.col("input_tokens") % 10) / 10.0)
    return metrics.overall(results(spark, folder).withColumn("f1", f1))


@query("wilson", f"with {RESULTS}, s as (select output_tokens user_id, count(*)::double n, sum(correct)::double c from re group by output_tokens) select user_id, {WILSON} from s")
def wilson(spark, folder):
    users = results(spark, folder).groupBy(F.col("output_tokens").alias("user_id")).agg(F.sum("correct").alias("c"), F.count(F.lit(1)).alias("n"))
    return users.select("user_id", metrics.wilson("c", "n").alias("ci")).select("user_id", "ci.*")


@query("percentile_nearest", f"with {RESULTS}, o as (select pipeline, latency, row_number() over (partition by pipeline order by latency) k, count(*) over (partition by pipeline) n from re where latency is not null) select pipeline, max(case when k = round_even(0.5 * (n - 1), 0) + 1 then latency end) p50, max(case when k = round_even(0.95 * (n - 1), 0) + 1 then latency end) p95 from o group by pipeline")
def percentile_nearest(spark, folder):
    return metrics.nearest_rank(results(spark, folder), ["pipeline"], "latency", {"p50": 0.5, "p95": 0.95})


@query("verdict", f"with {RESULTS}, t as (select pipeline, sum(correct) // 100 correct, sum(input_tokens) tokens from re group by pipeline), b as (select * from t where correct = (select max(correct) from t)) select arg_min(pipeline, (tokens, pipeline)) pipeline, count(*) = 1 decisive from b")
def verdict(spark, folder):
    totals = results(spark, folder).groupBy("pipeline").agg(F.floor(F.sum("correct") / 100).alias("correct"), F.sum("input_tokens").alias("tokens"))
    return metrics.verdict(totals)


@query("override_merge", f"with {RESULTS}, nw as (select qid, pipeline, correct + 10 correct from re where pipeline = 'click' and qid % 2 = 0) select qid, pipeline, correct from re where not (pipeline = 'click' and qid in (select qid from nw)) union all select * from nw")
def override_merge(spark, folder):
    rows = results(spark, folder).select("qid", "pipeline", "correct")
    newer = rows.where("pipeline = 'click' and qid % 2 = 0").withColumn("correct", F.col("correct") + 10)
    return metrics.override(rows, newer, "click")


@query("comparative_summary", f"with {RESULTS}, t as (select pipeline, count(*) n, sum(correct) c, avg(input_tokens + output_tokens) t from re group by pipeline) select a.pipeline, round(a.c / a.n - b.c / b.n, 6) accuracy_delta, round(round(a.t, 6) / round(b.t, 6), 6) token_ratio from t a, t b where b.pipeline = 'view' and a.pipeline <> 'view'")
def comparative_summary(spark, folder):
    totals = metrics.summary(results(spark, folder)).where("qtype is null")
    return metrics.compared(totals, "view")


@query("tool_frequency", "select role, value, count(*) n from (select role, unnest(list_filter(string_split(text, ' '), lambda w: length(w) = 4)) as value from conversations where text is not null) group by all")
def tool_frequency(spark, folder):
    rows = table(spark, folder, "conversations").select("role", F.filter(F.split("text", " "), lambda w: F.length(w) == 4).alias("tools"))
    return metrics.frequency(rows, ["role"], "tools")


@query("resume_check", f"with {RESULTS}, d as (select qid, 'q' || (qid - qid % 7 // 6) question, case when qid % 5 <> 0 then pipeline end answer from re where qid % 10 < 8 union all select qid, 'q' || qid, pipeline from re where qid % 100 = 1 union all select -qid - 1, 'x', pipeline from re where qid % 100 = 2), j as (select d.*, re.qid is null unknown, count(*) over (partition by d.qid) n from d left join re on re.qid = d.qid) select distinct qid, problem from (select qid, case when unknown then 'unknown' when question <> 'q' || qid then 'changed' when n > 1 then 'duplicate' when answer is null then 'incomplete' end problem from j) where problem is not null")
def resume_check(spark, folder):
    rows = results(spark, folder).select("qid", "pipeline")
    known = rows.select("qid", F.concat(F.lit("q"), F.col("qid").cast("string")).alias("question"))
    name = lambda n: F.concat(F.lit("q"), n.cast("string")).alias("question")
    done = rows.where("qid % 10 < 8").select("qid", name(F.col("qid") - F.floor(F.col("qid") % 7 / 6)), F.when(F.col("qid") % 5 != 0, F.col("pipeline")).alias("answer"))
    done = done.unionByName(rows.where("qid % 100 = 1").select("qid", name(F.col("qid")), F.col("pipeline").alias("answer"))).unionByName(rows.where("qid % 100 = 2").select((-F.col("qid") - 1).alias("qid"), F.lit("x").alias("question"), F.col("pipeline").alias("answer")))
    return metrics.resume_problems(done, known)


@query("accuracy_pivot", f"with {RESULTS} select qtype, " + ", ".join(f"coalesce(round(100.0 * avg(correct) filter (pipeline = '{p}'), 2), 0) {p}" for p in ("click", "view", "error")) + " from re group by qtype")
def accuracy_pivot(spark, folder):
    shares = results(spark, folder).groupBy("qtype").pivot("pipeline", ["click", "view", "error"]).agg(F.round(100 * F.avg("correct"), 2))
    return shares.fillna(0)


@query("answer_tokens", "select doc_id, greatest(1, length(text) // 4)::bigint tokens, regexp_matches(text, '(?i)^not found in corpus\\.?$') missing from documents where text is not null")
def answer_tokens(spark, folder):
    return table(spark, folder, "documents").where("text is not null").select("doc_id", tx.approximate_tokens(F.col("text")).alias("tokens"), tx.not_found(F.col("text")).alias("missing"))


@query("context_recall", f"with {BM25}, an as (select item_id query_id, array_to_string(string_split(text, ' ')[2:4], ' ') answer from benchmark), gi as (select query_id, {COMPACT.format(t='answer')} a from an where not regexp_full_match(replace(answer, ',', ''), '[0-9]+')), hi as (select distinct query_id from bm join gi using (query_id) join documents using (doc_id) where rank <= 5 and contains({COMPACT.format(t='coalesce(text, chr(32))')}, a)) select distinct query_id, (hi.query_id is not null)::int context_recall from gi left join hi using (query_id)")
def context_recall(spark, folder):
    words = F.split("text", " ")
    given = asked(spark, folder).select("query_id", F.array_join(F.slice(words, 2, 3), " ").alias("answer"))
    docs = corpus(spark, folder)
    ranked = retrieval.bm25(asked(spark, folder), docs, 5).select("query_id", F.col("doc_id").alias("id"))
    return metrics.context_recall(ranked, given, docs.select(F.col("doc_id").alias("id"), "text"))


@query("measure_spread", f"with {RESULTS}, lo as (select pipeline, 'latency' measure, latency::double as value from re union all select pipeline, 'input_tokens', input_tokens::double from re union all select pipeline, 'correct', correct::double from re) select pipeline, measure, round(avg(value), 6) mean, round(sum(value), 6) total, min(value) least, max(value) most, median(value) median from lo where value is not null group by all")
def measure_spread(spark, folder):
    return metrics.spread(results(spark, folder), ["pipeline"], ["latency", "input_tokens", "correct"])


@query("measures_wide", f"with {RESULTS}, lo as (select pipeline, 'correct' measure, correct::double as value from re union all select pipeline, 'fast', (latency < 30)::int::double from re) select measure, " + ", ".join(f"floor(avg(value) filter (pipeline = '{p}') * 1000 + 0.5) / 10 {p}" for p in ("click", "error", "purchase", "signup", "view")) + " from lo group by measure")
def measures_wide(spark, folder):
    rows = results(spark, folder).withColumn("fast", (F.col("latency") < 30).cast("int"))
    return metrics.measures_wide(rows, "pipeline", ["correct", "fast"])


@query("question_shapes", "with q as (select 'type ' || (user_id % 4) qtype, event_id % 4 g, event_id % 3 a from events) select coalesce(qtype, 'all') qtype, count(*) questions, round(avg(g), 6) mean_golds, count(*) filter (a > 1) several_answers from q group by grouping sets ((qtype), ())")
def question_shapes(spark, folder):
    rows = table(spark, folder, "events")
    many = lambda n: F.slice(F.array(*[F.lit(str(i)) for i in range(4)]), F.lit(1), n.cast("int"))
    questions = rows.select(F.concat(F.lit("type "), (F.col("user_id") % 4).cast("string")).alias("qtype"), many(F.col("event_id") % 4).alias("gold_doc_ids"), many(F.col("event_id") % 3).alias("answers"))
    return metrics.shapes(questions)


@query("dense_cutoffs", f"with {COSINE}, ra as (select query_id, id // 2 id, rank from ct where rank <= 30), go as (select distinct a.vec_id query_id, b.vec_id // 2 id from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id where a.vec_id % 100 = 0), f as (select query_id, id, min(rank) rank from ra group by all), pe as (select g.query_id, count(*) n, min(rank) f, " + ", ".join(f"count(*) filter (rank <= {k}) h{k}" for k in (5, 10, 30)) + " from go g left join f on f.query_id = g.query_id and f.id = g.id group by g.query_id) select " + ", ".join(f"round(avg(coalesce(f <= {k}, false)::int), 6) hit_{k}, round(avg(h{k} / n), 6) recall_{k}, round(avg(case when f <= {k} then 1.0 / f else 0 end), 6) mrr_{k}" for k in (5, 10, 30)) + " from pe")
def dense_cutoffs(spark, folder):
    """Two neighbouring vectors stand for the passages of one document."""
    labels, left = labelled(spark, folder)
    ranked = settled(near(spark, folder, 30).select("query_id", F.floor(F.col("id") / 2).alias("id"), "rank"))
    docs = labels.groupBy("label", F.floor(F.col("vec_id") / 2).alias("id")).agg(F.count(F.lit(1)).alias("_n"))
    alone = (F.col("id") == F.floor(F.col("query_id") / 2)) & (F.col("_n") == 1)  # the query itself is no gold
    gold = ranked.select("query_id", "id").join(left, "query_id").join(docs, ["label", "id"]).where(~alone).select("query_id", "id")
    own = left.withColumn("id", F.floor(F.col("query_id") / 2)).join(docs, ["label", "id"])
    counted = docs.groupBy("label").agg(F.count(F.lit(1)).alias("_all"))
    sizes = own.join(counted, "label").select("query_id", (F.col("_all") - F.when(alone, 1).otherwise(0)).alias("n_gold")).where("n_gold > 0")
    return metrics.dense_cutoffs(ranked, gold, sizes=sizes)
