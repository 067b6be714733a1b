"""Facts with validity intervals, and which of conflicting facts holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TOLERANCE = 1e-4
#: The smallest authority and confidence that count, and the bounds of p and the margin.
FLOOR, P_BOUNDS, MARGINS = 0.05, (0.05, 0.99), (0.04, 0.35)


def parse_time(text: Column) -> Column:
    """A timestamp (UTC, without zone) from a text: four digits are a year, else ISO forms with or without a zone; others are null."""
    text = F.trim(text)
    year = F.when(text.rlike("^\\d{4}$"), F.concat(text, F.lit("-01-01")).try_cast("timestamp_ntz"))
    zoned = F.when(text.rlike("(?i)(z|[+-]\\d{2}:?\\d{2})$"), F.try_to_timestamp(text).cast("timestamp_ntz"))
    plain = F.when(text.rlike("^\\d{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("timestamp_ntz")).when(text.rlike("^\\d{4}-\\d{2}-\\d{2}"), text.try_cast("timestamp_ntz"))
    return F.coalesce(year, zoned, plain)


def time_of_number(number: Column) -> Column:
    """The same from a number: a year from 1800 to 2200, else seconds since 1970."""
    year = F.when(number.between(1800, 2200), F.concat(F.floor(number).cast("string"), F.lit("-01-01")).try_cast("timestamp_ntz"))
    return F.coalesce(year, F.timestamp_seconds(number.cast("double")).cast("timestamp_ntz"))


def valid_at(instant: Column, superseded: Column | None = None) -> Column:
    """Whether a fact holds at an instant: open bounds hold always, a null instant is within any interval."""
    inside = F.coalesce(F.col("valid_from") <= instant, F.lit(True)) & F.coalesce(F.col("valid_to") >= instant, F.lit(True))
    return inside & (superseded.isNull() if superseded is not None else F.lit(True))


def overlaps(from_a: Column, to_a: Column, from_b: Column, to_b: Column) -> Column:
    """Whether two intervals share an instant; null bounds are open."""
    return F.coalesce(from_a <= to_b, F.lit(True)) & F.coalesce(from_b <= to_a, F.lit(True))


def unpivoted(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, predicate, value): one row for each attribute that is given; null and empty ones are left out."""
    long = rows.select(key, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot([key], columns, "predicate", "value")
    return long.where("value is not null and value <> ''")


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def confidence_interval(authority: Column, confidence: Column, n: int = 1) -> Column:
    """(low, high) around the confidence that a source's authority leaves."""
    a, c = clamp(authority, FLOOR, 1.0), clamp(confidence, FLOOR, 1.0)
    p = clamp(a * c, *P_BOUNDS)
    margin = clamp(1.96 * F.sqrt(p * (1 - p) / n) + 0.15 * (1 - a), *MARGINS)
    return F.struct(F.bround(F.greatest(p - margin, F.lit(0.0)), 3).alias("low"), F.bround(F.least(p + margin, F.lit(1.0)), 3).alias("high"))


def resolve(facts: DataFrame) -> DataFrame:
    """One row for each (subject, predicate): which fact holds, why, and how many are superseded.

    Facts stand by authority, valid_from and valid_to, each descending with null last, then fact_id.
    Only the first two are compared: equal values are no conflict, whatever comes after them; an
    authority ahead by more than TOLERANCE decides, else the later valid_from, then valid_to (a given
    one beats none), else both versions are reported. Authorities within the tolerance are still
    ordered, so the second fact may win by recency. Facts with another value than the winner's are
    superseded.
    """
    by_rank = W.partitionBy("subject", "predicate").orderBy(F.desc_nulls_last("source_authority"), F.desc_nulls_last("valid_from"), F.desc_nulls_last("valid_to"), "fact_id")
    fact = F.struct("fact_id", "value", "source_authority", "valid_from", "valid_to")
    group = facts.groupBy("subject", "predicate", "value").agg(F.count(F.lit(1)).alias("_n"))
    sizes = group.groupBy("subject", "predicate").agg(F.sum("_n").alias("n_facts"), F.count(F.lit(1)).alias("n_values"))
    top = facts.withColumn("_k", F.row_number().over(by_rank)).where("_k <= 2")
    pair = top.groupBy("subject", "predicate").agg(F.max(F.when(F.col("_k") == 1, fact)).alias("a"), F.max(F.when(F.col("_k") == 2, fact)).alias("b"))
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))

    def later(c: str) -> Column:
        """1 if the first is later, 2 if the second is, null if they are equal."""
        return F.when(a(c).eqNullSafe(b(c)), None).when(b(c).isNull() | (a(c) > b(c)), 1).otherwise(2)

    ahead = F.abs(a("source_authority") - b("source_authority")) > TOLERANCE
    reason = (
        F.when(F.col("b.fact_id").isNull(), "single")
        .when(a("value").eqNullSafe(b("value")), "no_conflict")
        .when(ahead, "authority")
        .when(later("valid_from").isNotNull(), "valid_from_timestamp")
        .when(later("valid_to").isNotNull(), "valid_to_timestamp")
        .otherwise("unresolved_tie")
    )
    winner = F.when(F.col("reason").isin("single", "no_conflict", "authority"), 1).when(F.col("reason") == "valid_from_timestamp", later("valid_from")).when(F.col("reason") == "valid_to_timestamp", later("valid_to"))
    decided = pair.withColumn("reason", reason).withColumn("_w", winner)
    decided = decided.withColumn("winner", F.when(F.col("_w") == 1, a("fact_id")).when(F.col("_w") == 2, b("fact_id"))).withColumn("_value", F.when(F.col("_w") == 1, a("value")).when(F.col("_w") == 2, b("value")))
    beaten = decided.where(F.col("reason").isin("authority", "valid_from_timestamp", "valid_to_timestamp")).select("subject", "predicate", "_value")
    lost = group.join(beaten, ["subject", "predicate"]).where(~F.col("value").eqNullSafe(F.col("_value"))).groupBy("subject", "predicate").agg(F.sum("_n").alias("n_superseded"))
    result = decided.select("subject", "predicate", "reason", "winner").join(sizes, ["subject", "predicate"]).join(lost, ["subject", "predicate"], "left")
    return result.withColumn("n_superseded", F.coalesce("n_superseded", F.lit(0)))


def conflict_edges(facts: DataFrame, resolved: DataFrame, event: str = "#") -> DataFrame:
    """(src, dst, conflict_type, resolution): from losing to winning events; self-edges are dropped.

    Fact ids may carry their event before a separator.
    """
    won = resolved.where("winner is not null and reason not in ('single', 'no_conflict')").select("subject", "predicate", F.col("reason").alias("resolution"), F.col("winner"))
    values = facts.select("fact_id", "subject", "predicate", "value")
    winning = values.select(F.col("fact_id").alias("winner"), F.col("value").alias("_won"))
    lost = values.join(won, ["subject", "predicate"]).join(winning, "winner").where(~F.col("value").eqNullSafe(F.col("_won")))
    edges = lost.select(F.split_part(F.col("fact_id").cast("string"), F.lit(event), F.lit(1)).alias("src"), F.split_part(F.col("winner").cast("string"), F.lit(event), F.lit(1)).alias("dst"), F.col("predicate").alias("conflict_type"), "resolution")
    return edges.where("src <> dst")


def conflicting_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(predicate, value_a, value_b) of two event versions' common predicates that differ; both are unpivoted."""
    left = a.select("subject", "predicate", F.col("value").alias("value_a"))
    return left.join(b.select("subject", "predicate", F.col("value").alias("value_b")), ["subject", "predicate"]).where("value_a <> value_b")


def superseded(facts: DataFrame, resolved: DataFrame) -> DataFrame:
    """facts with superseded_by: the winner's id on every fact of another value than it, where a conflict was decided."""
    decided = resolved.where(F.col("reason").isin("authority", "valid_from_timestamp", "valid_to_timestamp")).select("subject", "predicate", "winner")
    won = decided.join(facts.select(F.col("fact_id").alias("winner"), F.col("value").alias("_won")), "winner")
    marked = facts.join(won, ["subject", "predicate"], "left")
    lost = F.col("winner").isNotNull() & ~F.col("value").eqNullSafe(F.col("_won"))
    return marked.withColumn("superseded_by", F.when(lost, F.col("winner"))).drop("winner", "_won")


def superseded_events(marked: DataFrame, event: str = "#") -> DataFrame:
    """(event_id, superseded_by) to be merged into the event vertices; ids of facts may carry their event before a separator."""
    of = lambda c: F.split_part(F.col(c).cast("string"), F.lit(event), F.lit(1))
    return marked.where("superseded_by is not null").groupBy(of("fact_id").alias("event_id")).agg(F.max(of("superseded_by")).alias("superseded_by"))


def strategy_shifts(marked: DataFrame, resolved: DataFrame) -> DataFrame:
    """(subject, predicate, changed, event): what a trace says of each resolution; event is JSON."""
    lost = marked.where("superseded_by is not null").groupBy("subject", "predicate").agg(F.array_sort(F.collect_list(F.col("fact_id").cast("string"))).alias("superseded_fact_ids"))
    told = resolved.where("reason <> 'single'").join(lost, ["subject", "predicate"], "left")
    changed = F.col("reason") != "no_conflict"
    ids = F.coalesce("superseded_fact_ids", F.array().cast("array<string>"))
    event = F.to_json(F.struct(F.lit("strategy_shift").alias("event_type"), changed.alias("strategy_changed"), F.col("reason").alias("resolved_by"), F.col("winner").cast("string").alias("winner_fact_id"), ids.alias("superseded_fact_ids")), {"ignoreNullFields": "false"})
    return told.select("subject", "predicate", changed.alias("changed"), event.alias("event"))
