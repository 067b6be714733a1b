"""Answer and retrieval metrics as grouped aggregations; pipelines stay in long format."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventgraph.functions import text as tx
from eventgraph.operators.ordering import settled
from eventgraph.operators.retrieval import SENT

#: Prices of a million input and output tokens.
PRICES = (2.50, 10.00)
Z = 1.96

#: Ranges that an order statistic is sought in at once, and pipelines that a report may have as columns.
RANGES, MOST_COLUMNS = 1024, 100


def answer_key(answer: Column) -> Column:
    """An answer by its letters and digits only."""
    return F.regexp_replace(F.lower(tx.ascii_fold(answer)), "[^a-z0-9]+", "")


def exact_match(prediction: str, golds: str) -> Column:
    """1 if an answer equals one of the golds but for accents, case and signs; an empty one never does."""
    key = answer_key(F.col(prediction))
    return F.when(F.coalesce(key, F.lit("")) == "", 0).otherwise(F.exists(golds, lambda g: answer_key(g) == key).cast("int"))


def strict_match(prediction: str, golds: str) -> Column:
    return F.when(F.coalesce(F.trim(F.col(prediction)), F.lit("")) == "", 0).otherwise(F.exists(golds, lambda g: F.trim(g) == F.trim(F.col(prediction))).cast("int"))


def token_f1(answers: DataFrame) -> DataFrame:
    """(qid, f1): best F1 over the golds with multiset overlap; answers has qid, prediction and golds."""
    best = F.posexplode("golds").alias("_g", "_gold")
    pairs = answers.select("qid", tx.search_tokens(F.col("prediction")).alias("_p"), best)
    pairs = pairs.select("qid", "_g", "_p", tx.search_tokens(F.col("_gold")).alias("_t"))
    sizes = pairs.select("qid", "_g", F.size("_p").alias("np"), F.size("_t").alias("nt"))
    count = lambda side, n: pairs.select("qid", "_g", F.explode(side).alias("token")).groupBy("qid", "_g", "token").agg(F.count(F.lit(1)).alias(n))
    common = count("_p", "a").join(count("_t", "b"), ["qid", "_g", "token"]).groupBy("qid", "_g").agg(F.sum(F.least("a", "b")).alias("common"))
    scored = sizes.join(common, ["qid", "_g"], "left").select("qid", F.coalesce(2.0 * F.col("common") / (F.col("np") + F.col("nt")), F.lit(0.0)).alias("f1"))
    return scored.groupBy("qid").agg(F.round(F.max("f1"), 6).alias("f1"))


def gold_sizes(gold: DataFrame) -> DataFrame:
    """(query_id, n_gold)."""
    return gold.distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("n_gold"))


def retrieval(ranked: DataFrame, gold: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """One row a query: hit@1, hit@5, MRR, recall@5, precision@5, nDCG@5 and context precision.

    ranked has query_id, id and rank (from 1), gold has query_id and id. A repeated id counts once,
    at its first rank, for nDCG and context precision (average precision of the first five); MRR, recall and precision take the list as it
    is: precision divides distinct hits by the length of the first five. With sizes (query_id, n_gold) given, gold
    need only hold the golds that are ranked.
    """
    first = ranked.groupBy("query_id", "id").agg(F.min("rank").alias("at"))
    first = first.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy("at")))
    marked = first.join(gold.distinct().withColumn("_hit", F.lit(1)), ["query_id", "id"], "left").withColumn("hit", F.coalesce("_hit", F.lit(0)))
    running = F.sum("hit").over(W.partitionBy("query_id").orderBy("place").rowsBetween(W.unboundedPreceding, 0))
    marked = marked.withColumn("precision_here", running / F.col("place"))
    log2 = lambda c: F.log(c) / F.log(F.lit(2.0))
    listed = ranked.groupBy("query_id").agg(F.count_if(F.col("rank") <= 5).alias("n5"))
    golds = gold_sizes(gold) if sizes is None else sizes
    own = marked.groupBy("query_id").agg(
        F.min(F.when(F.col("hit") == 1, F.col("at"))).alias("first"),
        F.sum(F.when(F.col("at") <= 5, F.col("hit")).otherwise(0)).alias("hits5"),
        F.sum(F.when(F.col("place") <= 5, F.col("hit") / log2(F.col("place") + 1)).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(F.col("place") <= 5, F.col("hit") * F.col("precision_here")).otherwise(0.0)).alias("ap"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_gold"), F.lit(5)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / log2(i + 1))
    joined = own.join(listed, "query_id").join(golds, "query_id")
    return joined.select(
        "query_id",
        F.coalesce((F.col("first") == 1).cast("int"), F.lit(0)).alias("hit_1"),
        F.coalesce((F.col("first") <= 5).cast("int"), F.lit(0)).alias("hit_5"),
        F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.col("hits5") / F.col("n_gold"), 6).alias("recall_5"),
        F.round(F.try_divide(F.col("hits5"), F.col("n5")), 6).alias("precision_5"),
        F.round(F.col("dcg") / ideal, 6).alias("ndcg_5"),
        F.round(F.col("ap") / F.least(F.col("n_gold"), F.lit(5)), 6).alias("context_precision"),
    )


def wilson(successes: str | Column, total: str | Column) -> Column:
    """(low, high): the 95 % score interval of a share."""
    k, n = (F.col(c) if isinstance(c, str) else c for c in (successes, total))
    p = k / n
    centre, spread = p + Z * Z / (2 * n), Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))
    low, high = (centre - spread) / (1 + Z * Z / n), (centre + spread) / (1 + Z * Z / n)
    return F.struct(F.bround(F.greatest(low, F.lit(0.0)), 4).alias("low"), F.bround(F.least(high, F.lit(1.0)), 4).alias("high"))


def nearest_rank(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Percentiles that are values of the data: the one at index round(share * (n - 1)), halves to even.

    Nothing is sorted: rows are counted by RANGES equal ranges of value within their group, the range that
    holds the rank is cut again between its least and greatest value, until it holds one value. A round
    is one pass with map-side counts; three do for 10^9 different values. Null values count as not there; groups without
    values have no row.
    """
    given = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    same = lambda a, b: reduce(lambda x, k: x & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")), keys, F.lit(True))
    whole = given.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("_name"), F.lit(float(s)).alias("_share")) for n, s in shares.items()]))
    wanted = whole.select("*", named.alias("_p")).select(*keys, F.col("_p._name").alias("_name"), F.bround(F.col("_p._share") * (F.col("_n") - 1), 0).cast("long").alias("_left"), "_low", "_high")
    wanted, done = settled(wanted), None
    while True:
        ready = wanted.where("_low = _high").select(*keys, "_name", F.col("_low").alias("_value"))
        done = ready if done is None else done.unionByName(ready)
        open_ = wanted.where("_low < _high")
        if open_.isEmpty():
            break
        met = given.alias("g").join(open_.alias("w"), same("g", "w") & F.col("_v").between(F.col("_low"), F.col("_high")))
        cut = F.least(F.floor((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * RANGES), F.lit(RANGES - 1)).alias("_range")
        counted = met.groupBy(*[F.col(f"w.{k}").alias(k) for k in keys], "_name", "_left", cut).agg(F.count(F.lit(1)).alias("_k"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        before = F.coalesce(F.sum("_k").over(W.partitionBy(*keys, "_name").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # RANGES rows at most
        placed = counted.withColumn("_before", before).where((F.col("_before") <= F.col("_left")) & (F.col("_left") < F.col("_before") + F.col("_k")))
        wanted = settled(placed.select(*keys, "_name", (F.col("_left") - F.col("_before")).alias("_left"), "_low", "_high"))
    return done.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == n, F.col("_value"))).alias(n) for n in shares])


def summary(rows: DataFrame) -> DataFrame:
    """Per pipeline and question type, and per pipeline over all types (qtype null), in one pass.

    rows has pipeline, qtype, correct (0 or 1), input_tokens, output_tokens and latency.
    """
    totals = rows.rollup("pipeline", "qtype").agg(
        F.grouping_id().alias("_g"),
        F.count(F.lit(1)).alias("n"),
        F.sum("correct").alias("correct"),
        F.round(F.avg("latency"), 6).alias("mean_latency"),
        F.round(F.avg(F.col("input_tokens") + F.col("output_tokens")), 6).alias("mean_tokens"),
        F.round(100 * (PRICES[0] * F.avg("input_tokens") + PRICES[1] * F.avg("output_tokens")) / 1e6, 6).alias("cost_per_100"),
    )
    return totals.where("_g < 3").drop("_g").withColumn("ci", wilson("correct", "n")).select("*", "ci.low", "ci.high").drop("ci")


def overall(rows: DataFrame) -> DataFrame:
    """One row a pipeline: exact matches with their interval, mean F1, mean tokens, latency at the middle and at 95 percent, and cost of 100.

    rows has pipeline, correct (0 or 1), f1, input_tokens, output_tokens and latency.
    """
    sums = rows.groupBy("pipeline").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("correct").alias("correct"),
        F.round(F.avg("f1"), 6).alias("mean_f1"),
        F.round(F.avg(F.col("input_tokens") + F.col("output_tokens")), 6).alias("mean_tokens"),
        F.round(100 * (PRICES[0] * F.avg("input_tokens") + PRICES[1] * F.avg("output_tokens")) / 1e6, 6).alias("cost_per_100"),
    )
    ranks = nearest_rank(rows, ["pipeline"], "latency", {"latency_p50": 0.5, "latency_p95": 0.95})
    return sums.withColumn("ci", wilson("correct", "n")).select("*", "ci.low", "ci.high").drop("ci").join(ranks, "pipeline", "left")


def verdict(totals: DataFrame) -> DataFrame:
    """The cheapest of the pipelines with most correct answers, and whether it alone has so many."""
    best = totals.withColumn("_k", F.rank().over(W.orderBy(F.desc("correct")))).where("_k = 1")  # one row a pipeline
    return best.agg(F.min_by("pipeline", F.struct("tokens", "pipeline")).alias("pipeline"), (F.count(F.lit(1)) == 1).alias("decisive"))


def override(rows: DataFrame, newer: DataFrame, pipeline: str) -> DataFrame:
    """Long results with one pipeline's rows replaced where the newer run has the question."""
    stays = rows.join(newer.select("qid", F.lit(pipeline).alias("pipeline")).distinct(), ["qid", "pipeline"], "left_anti")
    return stays.unionByName(newer.where(F.col("pipeline") == pipeline))


def resume_problems(done: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, problem): checkpoint rows that are unknown, changed, repeated or incomplete."""
    joined = done.join(questions.select("qid", F.col("question").alias("_q")), "qid", "left")
    counted = joined.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("qid")))
    problem = F.when(F.col("_q").isNull(), "unknown").when(F.col("_q") != F.col("question"), "changed").when(F.col("_n") > 1, "duplicate").when(F.col("answer").isNull(), "incomplete")
    return counted.select("qid", problem.alias("problem")).where("problem is not null").distinct()


def compared(totals: DataFrame, base: str) -> DataFrame:
    """Each pipeline against a base: accuracy difference and token ratio."""
    own = totals.where(F.col("pipeline") == base).select((F.col("correct") / F.col("n")).alias("_a"), F.col("mean_tokens").alias("_t"))
    others = totals.where(F.col("pipeline") != base).crossJoin(F.broadcast(own))  # one row
    return others.select("pipeline", F.round(F.col("correct") / F.col("n") - F.col("_a"), 6).alias("accuracy_delta"), F.round(F.col("mean_tokens") / F.col("_t"), 6).alias("token_ratio"))


def frequency(rows: DataFrame, keys: list[str], array: str) -> DataFrame:
    """How often each value of an array column is there."""
    return rows.select(*keys, F.explode(array).alias("value")).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))


def cutoffs(ranked: DataFrame, gold: DataFrame, at: tuple[int, ...] = (5, 10, 30), sizes: DataFrame | None = None) -> DataFrame:
    """Hit rate, recall and MRR at cutoffs over all queries that have golds; sizes as in retrieval."""
    hits = ranked.join(gold.distinct(), ["query_id", "id"])
    sizes = gold_sizes(gold) if sizes is None else sizes
    per = sizes.join(hits.groupBy("query_id").agg(F.min("rank").alias("first"), *[F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in at]), "query_id", "left")
    columns = []
    for k in at:
        columns += [F.round(F.avg(F.coalesce((F.col("first") <= k).cast("int"), F.lit(0))), 6).alias(f"hit_{k}"), F.round(F.avg(F.coalesce(F.col(f"h{k}"), F.lit(0)) / F.col("n_gold")), 6).alias(f"recall_{k}"), F.round(F.avg(F.when(F.col("first") <= k, 1.0 / F.col("first")).otherwise(0.0)), 6).alias(f"mrr_{k}")]
    return per.agg(*columns)


def context_recall(ranked: DataFrame, answers: DataFrame, articles: DataFrame) -> DataFrame:
    """(query_id, context_recall): 1 if a retrieved article states an answer, spaces and signs aside.

    ranked has query_id and id, answers has query_id and answer, articles has id and text. Mere
    numbers are no answers here; a query without others is left out. Every article is folded once,
    and only those that are retrieved.
    """
    given = answers.where(~F.replace("answer", F.lit(","), F.lit("")).rlike("^[0-9]+$")).select("query_id", tx.compact(F.col("answer")).alias("_a")).distinct()
    ranked = settled(ranked.select("query_id", "id").distinct())  # read twice
    wanted = ranked.select("id").distinct()
    few = wanted.limit(SENT + 1).count() <= SENT
    texts = articles.join(F.broadcast(wanted) if few else wanted, "id", "left_semi").select("id", F.coalesce(tx.compact(F.col("text")), F.lit("")).alias("_t"))  # never null, or Spark would fold all texts to test for it
    found = ranked.join(given, "query_id").join(texts, "id").where(F.contains("_t", "_a")).select("query_id").distinct().withColumn("_hit", F.lit(1))
    return given.select("query_id").distinct().join(found, "query_id", "left").select("query_id", F.coalesce("_hit", F.lit(0)).alias("context_recall"))


def spread(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Mean, sum, minimum, maximum and median (of an even number: the mean of the middle two) of columns by group, one row a column."""
    long = rows.select(*keys, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(keys, values, "measure", "value").where("value is not null")
    return long.groupBy(*keys, "measure").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.sum("value"), 6).alias("total"), F.min("value").alias("least"), F.max("value").alias("most"), F.median("value").alias("median"))


def measures_wide(rows: DataFrame, pipeline: str, measures: list[str]) -> DataFrame:
    """One row a measure, a column a pipeline, as thousandths rounded to tenths of a percent."""
    names = [r[0] for r in rows.select(pipeline).distinct().orderBy(pipeline).limit(MOST_COLUMNS + 1).collect()]
    if len(names) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} pipelines are no columns")
    long = rows.select(pipeline, *[F.col(m).cast("double").alias(m) for m in measures]).unpivot([pipeline], measures, "measure", "value")
    return long.groupBy("measure").pivot(pipeline, names).agg(F.floor(F.avg("value") * 1000 + 0.5) / 10)


def shapes(questions: DataFrame) -> DataFrame:
    """Questions by type, and all of them: how many, with how many gold documents, and with several answers."""
    sums = [F.count(F.lit(1)).alias("questions"), F.round(F.avg(F.size("gold_doc_ids")), 6).alias("mean_golds"), F.count_if(F.size("answers") > 1).alias("several_answers")]
    return questions.groupBy("qtype").agg(*sums).unionByName(questions.agg(F.lit("all").alias("qtype"), *sums))


def dense_cutoffs(ranked: DataFrame, gold: DataFrame, at: tuple[int, ...] = (5, 10, 30), sizes: DataFrame | None = None) -> DataFrame:
    """The cutoffs of a ranking of passages (query_id, id, rank) whose document may come again.

    Ranks are those of passages: a document that is there twice takes two places; recall counts it once.
    """
    first = ranked.groupBy("query_id", "id").agg(F.min("rank").alias("rank"))
    return cutoffs(first, gold, at, sizes)
