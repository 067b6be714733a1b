"""Mixing sources to target weights by capped water-filling and seeded repetitions.

Targets. A budget of words is shared over the sources by weight. A source never gets more than
``max_epochs`` times its own words; what a clamped source leaves over goes to the others by weight,
until no source is above its cap. With sources ordered by cap / weight the clamped ones are a prefix
of that order, so the level comes from two running sums instead of a loop.

Repetitions. A source with target ``t`` and ``s`` words is repeated ``floor(t / s)`` whole times. For
the rest, its documents stand in a seeded order (an MD5 of seed and id) and are taken once more as
long as their running sum fits the rest; one further document, the one whose size is nearest to what
is then missing, tops the source up if that brings it nearer to its target.

Scale. The seeded order is dealt into ``buckets`` per source by its leading digits. Only bucket sums
are ordered per source; running sums within a bucket are a window over (source, bucket), so a source
with a third of all rows is spread over ``buckets`` groups. One row per source is all that is ever in
one task.

Defined cases. Null text: no words, taken 0 times more than its source's whole repetitions, which
adds nothing. Null source: a source of its own, last in order. Repeated rows: each row counts and is
sampled for itself; rows that agree in id and size are interchangeable. Null ids sort first within a
bucket. All sizes 0: all targets 0. Empty table: no rows. Extra columns of any name
stay with ``apply``; ``mix`` carries those asked for, and its own columns win over equal names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventgraph.llm.common import columns_of, word_count

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"
#: Hex digits of the seeded order that name a bucket: 16 ** 3 = 4096 buckets a source at most.
BUCKET_DIGITS = 3


def water_levels(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> the same with target: one row per source in, one out."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    by_ratio = W.orderBy("_ratio", F.col("source").asc_nulls_last())
    before, everything = by_ratio.rowsBetween(W.unboundedPreceding, -1), W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1))
    ranked = ranked.withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs))).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    left = F.lit(float(budget)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    weight = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    levels = ranked.withColumn("_left", left).withColumn("_weight", weight)
    # the first source, by cap / weight, whose share fits below its cap sets the level for all after it
    first = F.min(F.when(F.col("_w") * F.col("_left") <= F.col("_cap") * F.col("_weight"), F.struct("_ratio", F.col("source").isNull().alias("n"), "source", "_left", "_weight"))).over(everything)
    free = F.struct("_ratio", F.col("source").isNull().alias("n"), "source") >= F.struct(F.col("_f._ratio"), F.col("_f.n").alias("n"), F.col("_f.source").alias("source"))
    target = F.when(F.col("_f").isNotNull() & free, F.col("_w") * F.col("_f._left") / F.col("_f._weight")).otherwise(F.col("_cap"))
    return levels.withColumn("_f", first).select("source", "source_size", target.alias("target"))


def _same(a: str, b: str) -> Column:
    return F.expr(f"{a}.source <=> {b}.source and {a}._bucket = {b}._bucket")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS, seed: str = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, repeats, taken and the carried columns of each row.

    docs has doc_id, source and text. repeats says how often the mix takes the row (0 to max_epochs),
    taken is repeats times size.
    """
    columns_of(docs, "doc_id source text " + " ".join(carry))
    added = {"doc_id", "source", "size", "source_size", "target", "repeats", "taken"}
    carry = tuple(c for c in carry if c.lower() not in added)
    carried = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in carry]).alias("_carried")
    order = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    seeded = docs.select("doc_id", "source", word_count("text").alias("size"), order.alias("_order"), carried)
    seeded = seeded.withColumn("_bucket", F.substring("_order", 1, BUCKET_DIGITS))
    slim = seeded.drop("_carried")

    sums = slim.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    levels = water_levels(sums.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, budget, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    levels = levels.withColumn("_whole", whole).withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
    ahead = W.partitionBy("source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    ahead = sums.select("source", "_bucket", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    buckets = ahead.alias("a").join(levels.alias("b"), F.expr("a.source <=> b.source")).select("a.source", "_bucket", "_ahead", "source_size", "target", "_whole", "_rest")

    def placed(rows: DataFrame, parts: DataFrame) -> DataFrame:
        """Rows with their running sum over the source's seeded order."""
        running = W.partitionBy("a.source", "a._bucket").orderBy(F.col("_order"), F.col("doc_id"), F.col("size")).rowsBetween(W.unboundedPreceding, 0)
        joined = rows.alias("a").join(parts.alias("b"), _same("a", "b"))
        return joined.withColumn("_sum", F.col("_ahead") + F.sum("size").over(running)).drop("_ahead").drop(F.col("b.source")).drop(F.col("b._bucket"))

    fits = F.col("_sum") <= F.col("_rest")
    reached = placed(slim, buckets).where(fits).groupBy("source").agg(F.max("_sum").alias("_reached"))
    missing = buckets.alias("a").join(reached.alias("b"), F.expr("a.source <=> b.source"), "left").select(*[F.col(f"a.{c}") for c in buckets.columns], (F.col("_rest") - F.coalesce("_reached", F.lit(0))).alias("_missing"))
    off = F.abs(F.col("size") - F.col("_missing"))
    nearest = placed(slim, missing).where(~fits & (F.col("size") > 0) & (off < F.col("_missing"))).groupBy("source").agg(F.min(F.struct(off.alias("off"), F.col("_order"), F.col("_sum"))).alias("_top"))
    topped = buckets.alias("a").join(nearest.alias("b"), F.expr("a.source <=> b.source"), "left").select(*[F.col(f"a.{c}") for c in buckets.columns], F.col("b._top._sum").alias("_extra"))
    once_more = fits | ((F.col("_sum") == F.col("_extra")) & (F.col("size") > 0))
    result = placed(seeded, topped).withColumn("repeats", F.col("_whole") + F.when(F.coalesce(once_more, fits, F.lit(False)) & (F.col("_whole") < max_epochs), 1).otherwise(0))
    return result.select("doc_id", "source", "size", "source_size", "target", "repeats", (F.col("repeats") * F.col("size")).alias("taken"), *[F.col(f"_carried.`{c}`") for c in carry])


def apply(docs: DataFrame, **settings) -> DataFrame:
    """The mixed corpus: every row as often as the mix takes it, with docs' own columns."""
    whole = docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    mixed = mix(whole, carry=("_row",), **settings)
    copies = mixed.where("repeats > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))))
    return copies.select("_row.*")


def levels_sql(weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS) -> str:
    """WITH parts s (one row per source) to levels (source, source_size, target), over base (source, size)."""
    cases = " ".join(f"when {i} then {float(w)}" for i, w in enumerate(weights))
    return f"""
s as (select source, sum(size)::bigint source_size from base group by source),
w as (select *, case (row_number() over (order by source nulls last) - 1) % {len(weights)} {cases} end::double w, {float(max_epochs)} * source_size cap from s),
r as (select *, row_number() over (order by cap / w, source nulls last) k from w),
l as (select *, {float(budget)} * sum(source_size) over () - coalesce(sum(cap) over (order by k rows between unbounded preceding and 1 preceding), 0) lft,
             sum(w) over () - coalesce(sum(w) over (order by k rows between unbounded preceding and 1 preceding), 0) wgt from r),
f as (select min(k) k0 from l where w * lft <= cap * wgt),
levels as (select source, source_size, case when k >= k0 then w * (select lft from l where k = k0) / (select wgt from l where k = k0) else cap end::double target from l, f)"""


def mix_sql(base: str, seed: str = SEED, max_epochs: int = MAX_EPOCHS) -> str:
    """DuckDB: base is a query for (doc_id, source, size); ends in a table mixed."""
    return f"""
base as ({base}),{levels_sql(max_epochs=max_epochs)},
o as (select b.*, source_size, target, md5('{seed}:' || coalesce(doc_id::varchar, '')) h,
        case when source_size > 0 then floor(target / source_size) else 0 end::bigint whole
      from base b join levels l on b.source is not distinct from l.source),
c as (select *, target - whole * source_size rest, sum(size) over (partition by source order by h, doc_id, size rows unbounded preceding) cum from o),
m as (select source, any_value(rest) - coalesce(max(case when cum <= rest then cum end), 0) missing from c group by source),
t as (select c.source, min((abs(size - missing), h, cum))[3] extra from c join m on c.source is not distinct from m.source
      where not cum <= rest and size > 0 and abs(size - missing) < missing group by c.source),
mixed as (select c.doc_id, c.source, size, source_size, target, whole + case when whole < {max_epochs} and (cum <= rest or (size > 0 and cum = coalesce(extra, -1))) then 1 else 0 end repeats
      from c left join t on c.source is not distinct from t.source)"""


OP1_SQL = f"""with {mix_sql("select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+'))::bigint size from documents")}
select doc_id, size, source_size, target, (repeats * size)::bigint taken from mixed"""


def op1_mix_sources(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
