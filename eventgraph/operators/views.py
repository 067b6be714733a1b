"""Graph projections: nodes and edges for views of the event graph, and its statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventgraph.operators.ordering import numbered

LINKS, RIVALS = 400, 12


def games() -> Column:
    return F.concat(F.col("year").cast("string"), F.lit(" "), "season")


def weight(n: Column) -> Column:
    """Size of a node by what it stands for."""
    return F.bround(1 + 2.2 * F.log1p(n), 2)


def stats(events: DataFrame) -> DataFrame:
    links = events.groupBy("series_id").count().agg(F.sum(F.col("count") - 1).alias("edition_links"))
    counts = events.agg(F.count(F.lit(1)).alias("events"), F.count_distinct("season", "year").alias("games"), F.count_distinct("sport").alias("sports"), F.count_distinct("venue").alias("venues"))
    return counts.crossJoin(F.broadcast(links))  # one row


def constellation(events: DataFrame) -> DataFrame:
    """Games and sports with the number of events between them."""
    return events.groupBy(games().alias("games"), "sport").agg(F.count(F.lit(1)).alias("events")).withColumn("weight", weight(F.col("events")))


def venues(events: DataFrame) -> DataFrame:
    return events.where("venue is not null").select("venue", games().alias("games")).distinct()


def lineage(events: DataFrame, sport: str = "") -> DataFrame:
    """Consecutive editions of a sport's series; without a sport, of the busiest (the last by name of equals)."""
    busiest = events.groupBy("sport").count().agg(F.max_by("sport", F.struct("count", "sport")).alias("sport"))
    chosen = events.where(F.col("sport") == sport) if sport else events.join(F.broadcast(busiest), "sport")  # one row
    by_time = W.partitionBy("series_id").orderBy("year", "event_date", "event_id")
    links = chosen.select(F.col("event_id").alias("src"), F.lead("event_id").over(by_time).alias("dst")).where("dst is not null")
    return links.orderBy("src", "dst").limit(LINKS)


def investigation(chosen: DataFrame, events: DataFrame, precedes: DataFrame) -> DataFrame:
    """(event_id, kind, node): Games, sport, venue, neighbours in the series and some rivals of events."""
    edge = lambda rows, kind, node: rows.where(node.isNotNull()).select("event_id", F.lit(kind).alias("kind"), node.cast("string").alias("node"))
    back = chosen.select("event_id").join(precedes, F.col("event_id") == F.col("src"))
    ahead = chosen.select("event_id").join(precedes, F.col("event_id") == F.col("dst"))
    # an event's first rivals are among its group's first events, so no group is paired with itself
    group = ["sport", "year", "season"]
    first = events.select(F.col("event_id").alias("other"), *group).withColumn("_o", F.row_number().over(W.partitionBy(*group).orderBy("other"))).where(F.col("_o") <= RIVALS + 1)
    rivals = chosen.select("event_id", *group).join(first, group).where("event_id <> other")
    rivals = rivals.withColumn("_k", F.row_number().over(W.partitionBy("event_id").orderBy("other"))).where(F.col("_k") <= RIVALS)
    parts = [edge(chosen, "GAMES", games()), edge(chosen, "SPORT", F.col("sport")), edge(chosen, "VENUE", F.col("venue")), edge(back, "PREVIOUS", F.col("dst")), edge(ahead, "NEXT", F.col("src")), edge(rivals, "RIVAL", F.col("other"))]
    return reduce(DataFrame.unionByName, parts)


def first_writer(rows: DataFrame, keys: list[str], priority: str) -> DataFrame:
    """One row a key: the one with the least priority number."""
    return rows.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(priority))).where("_k = 1").drop("_k")


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, neighbours) in both directions; self-edges are dropped."""
    real = edges.where("src <> dst")
    both = real.select(F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(real.select(F.col("dst").alias("node"), F.col("src").alias("other")))
    return both.groupBy("node").agg(F.array_join(F.array_sort(F.collect_list("other")).cast("array<string>"), ",").alias("neighbours"))


def batches(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Contiguous batch numbers in key order; a size of 0 or less is one batch.

    Positions come from ranges of the key, of any type, and their counts, so no task sees all rows.
    """
    if size <= 0:
        return rows.withColumn("batch", F.lit(0).cast("long"))
    return numbered(rows, key, into="_n").select(*rows.columns, F.floor(F.col("_n") / size).cast("long").alias("batch"))
