"""Joins of rows by similar sets, by shared time and by texts within texts, without comparing all pairs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of the texts that are asked about in one pass.
PASS_BYTES = 1 << 20


def keyed(rows: DataFrame, frequency: DataFrame, least: float) -> DataFrame:
    """(row_id, ranked, token, own, other): under which tokens a row meets rows of which size.

    ranked has the tokens from the rarest on; frequency is (token, n). With a Dice coefficient of at least t, sets of
    sizes a and b share t * (a + b) / 2 tokens, so the rarest of these is followed by as many less one in both. A
    token at a place meets only sizes for which enough tokens follow; a frequent one stands last, where none do.
    """
    each = rows.select("row_id", F.explode("tokens").alias("token")).join(frequency, "token", "left")
    ranked = each.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))).alias("_order")).select("row_id", F.col("_order.token").alias("ranked"))
    placed = ranked.select("row_id", "ranked", F.size("ranked").alias("own"), F.posexplode("ranked").alias("_at", "token"))
    least_size = F.greatest(F.lit(1), F.ceil(F.col("own") * least / (2 - least) - 1e-9)).cast("int")
    most = F.least((F.col("own") - F.col("_at")) * 2 / least - F.col("own"), F.col("own") * (2 - least) / least)
    sizes = F.when(F.floor(most + 1e-9) >= least_size, F.sequence(least_size, F.floor(most + 1e-9).cast("int")))
    return placed.select("row_id", "ranked", "token", "own", F.explode(sizes).alias("other"))


def similar_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(left, right, n): pairs of rows of equal group whose distinct tokens have a Dice coefficient of at least least, and how many they share.

    Both have row_id (one of its own for each row), group, tokens and any other columns, which come back as structs.
    Rows meet on the rarest tokens, in order of their frequency in right, and on both sizes at once: a token that all
    rows have joins none but sets that have next to nothing else. Sets without tokens are similar to none.
    """
    frequency = right.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))

    def side(rows: DataFrame, name: str) -> DataFrame:
        whole = rows.select("row_id", F.struct(*rows.columns).alias(name), F.col("group").alias("_group"))
        met = keyed(rows.select("row_id", "tokens"), frequency, least).withColumnRenamed("ranked", f"_{name}")
        own, other = ("_a", "_b") if name == "left" else ("_b", "_a")
        return met.join(whole, "row_id").drop("row_id").withColumnsRenamed({"own": own, "other": other})

    met = side(left, "left").join(side(right, "right"), ["token", "_group", "_a", "_b"])
    shared = F.array_intersect("_left", "_right")
    first = met.where(F.col("token") == shared[0])  # a pair that meets under several tokens counts once
    return first.select("left", "right", F.size(shared).alias("n"), "_a", "_b").where(2.0 * F.col("n") >= least * (F.col("_a") + F.col("_b")) - 1e-9).drop("_a", "_b")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], width: int, start: str = "start", end: str = "end") -> DataFrame:
    """(left, right): pairs of rows with equal keys whose intervals share an instant; null bounds are open, rows without a key are in none.

    Intervals are cut at multiples of width seconds and rows meet within a stretch, so a common key is as many
    groups as stretches; a pair that shares several is kept in the first. Open bounds reach as far as any
    other bound of both tables. Empty intervals (end before start) overlap what they would by their two bounds.
    """
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    reach = lambda rows: rows.select(F.least(seconds(start), seconds(end)).alias("low"), F.greatest(seconds(start), seconds(end)).alias("high"))
    far = reach(left).unionByName(reach(right)).agg(F.coalesce(F.min("low"), F.lit(0.0)).alias("_low"), F.coalesce(F.max("high"), F.lit(0.0)).alias("_high"))

    def side(rows: DataFrame, name: str) -> DataFrame:
        bounded = rows.crossJoin(F.broadcast(far))  # one row
        first, last = (F.floor(F.coalesce(seconds(c), F.col(edge)) / width).cast("long") for c, edge in ((start, "_low"), (end, "_high")))
        cut = bounded.select(F.struct(*rows.columns).alias(name), *[F.col(k).alias(f"_{k}") for k in keys], F.least(first, last).alias(f"_{name}"), F.explode(F.sequence(F.least(first, last), F.greatest(first, last))).alias("_stretch"))
        return cut

    met = side(left, "left").join(side(right, "right"), [*(f"_{k}" for k in keys), "_stretch"])
    once = met.where(F.col("_stretch") == F.greatest("_left", "_right"))
    share = lambda a, b: F.coalesce(F.col(f"{a}.{start}") <= F.col(f"{b}.{end}"), F.lit(True))
    return once.where(share("left", "right") & share("right", "left")).select("left", "right")


def contained(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """(asked, text): pairs of distinct texts of which one is within the other; both frames have one text column. Null and empty ones are in none.

    Asked texts are taken in passes of about PASS_BYTES. An automaton of a pass's texts is walked once along each of the
    others; one of a batch of the others is walked along the pass's. So the work is that of reading, not of pairs.
    """
    import ahocorasick

    own = asked.select(F.col(asked.columns[0]).alias("asked")).where("asked <> ''").distinct()
    others = texts.select(F.col(texts.columns[0]).alias("text")).where("text <> ''").distinct()
    n = max(1, -(-(own.agg(F.sum(F.octet_length("asked").cast("long"))).first()[0] or 0) // PASS_BYTES))

    def machine(words: list[str]):
        made = ahocorasick.Automaton()
        for w in words:
            made.add_word(w, w)
        made.make_automaton()
        return made

    found = None
    for number in range(n):
        words = [r[0] for r in own.where(F.pmod(F.xxhash64("asked"), F.lit(n)) == number).collect()]  # about PASS_BYTES

        def run(batches: Iterator[pa.RecordBatch], words=words) -> Iterator[pa.RecordBatch]:
            of_pass = machine(words) if words else None
            for batch in batches:
                there = batch.column(0).to_pylist()
                if not there or not words:
                    continue
                pairs = {(w, t) for t in there for _, w in of_pass.iter(t)}
                of_batch = machine(there)
                pairs |= {(w, t) for w in words for _, t in of_batch.iter(w)}
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string())], ["asked", "text"])

        part = others.mapInArrow(run, "asked string, text string")
        found = part if found is None else found.unionByName(part)
    return found


def dice(n: Column, left: Column, right: Column) -> Column:
    return 2.0 * n / (left + right)
