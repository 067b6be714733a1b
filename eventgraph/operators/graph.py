"""Queries over event vertices and their edges, and how vertices and edges are stored.

Unknown numbers are 0 and unknown texts empty; an empty or zero parameter switches its filter off,
so that the filters that remain can be pushed to the scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: More matches than this at a venue and date are no answer.
MOST_AT_VENUE = 20
#: A venue fragment is shortened to this many words, in at most this many tries.
VENUE_WORDS, VENUE_TRIES = 3, 4
#: Names that a listing shows.
LISTED = 25


def same_text(column: str, wanted: str) -> Column:
    """Equal without regard to case."""
    return F.lower(column) == F.lit(wanted.lower())


def holds(column: str, fragment: str) -> Column:
    """Contains a fragment without regard to case; % and _ have no special meaning."""
    return F.contains(F.lower(column), F.lit(fragment.lower()))


def only(rows: DataFrame, conditions: list[Column]) -> DataFrame:
    return rows.where(reduce(lambda a, b: a & b, conditions)) if conditions else rows


def aggregates(events: DataFrame, sport: str = "", year: int = 0, least: int = 0, most: int = 0) -> DataFrame:
    """match_count, the documents behind the matches and the first names of the events of a sport and
    year within competitor bounds. Documents are counted apart, so that several of one event do not
    inflate match_count; names are cut to the first ones before they are gathered.
    """
    conditions = [c for ok, c in ((sport, same_text("sport", sport)), (year, F.col("year") == year), (least, F.col("competitor_count") >= least), (most, F.col("competitor_count") <= most)) if ok]
    found = only(events, conditions)
    return found.agg(F.count(F.lit(1)).alias("match_count"), F.count_distinct("doc_id").alias("doc_count")).crossJoin(F.broadcast(listed(found)))


def listed(found: DataFrame, most: int = LISTED) -> DataFrame:
    """One row with the first distinct names, joined by a semicolon."""
    first = found.select("name").distinct().orderBy("name").limit(most)
    return first.agg(F.array_join(F.array_sort(F.collect_list("name")), "; ").alias("listed"))


def edges_back(events: DataFrame, series: str = "series_id") -> DataFrame:
    """PRECEDES edges (src, dst, time_diff): from each edition to the one before it in its series."""
    by_time = W.partitionBy(series).orderBy("event_date", "event_id")
    edges = events.select(F.col("event_id").alias("src"), F.lag("event_id").over(by_time).alias("dst"), (F.col("year") - F.lag("year").over(by_time)).alias("time_diff"))
    return edges.where("dst is not null")


def preceding(events: DataFrame, precedes: DataFrame, sport: str = "", gender: str = "", fragment: str = "", year: int = 0) -> DataFrame:
    """The editions before the matching ones. The year always applies, 0 included."""
    conditions = [F.col("year") == year] + [c for ok, c in ((sport, same_text("sport", sport)), (gender, same_text("gender", gender)), (fragment, holds("name", fragment))) if ok]
    now = only(events, conditions).select(F.col("event_id").alias("src"), F.col("name").alias("event"))
    prior = events.select(F.col("event_id").alias("dst"), F.col("name").alias("prior_event"), F.col("year").alias("prior_year"), "gold_athlete", "doc_id")
    return now.join(precedes, "src").join(prior, "dst")


def superlative(events: DataFrame, sport: str = "", year: int = 0, season: str = "", order: str = "desc", limit: int = 1) -> DataFrame:
    """The events with the most (only with order "desc") or fewest competitors; unknown counts take part."""
    conditions = [c for ok, c in ((sport, same_text("sport", sport)), (year, F.col("year") == year), (season, same_text("season", season))) if ok]
    count = F.col("competitor_count").desc() if order == "desc" else F.col("competitor_count").asc()
    return only(events, conditions).orderBy(count, "name", "event_id").limit(max(limit, 0))


def attributes(events: DataFrame, fragment: str, year: int = 0, sport: str = "", gender: str = "") -> DataFrame:
    """The attributes of the events whose name holds a fragment; a blank fragment matches nothing."""
    if not fragment.strip():
        return events.where(F.lit(False))
    conditions = [holds("name", fragment.strip())] + [c for ok, c in ((year, F.col("year") == year), (sport, same_text("sport", sport)), (gender, same_text("gender", gender))) if ok]
    return only(events, conditions)


def venue_variants(venue: str, relax: bool = True) -> list[str]:
    """A venue fragment and, last words dropped, its shorter forms."""
    words = venue.split()
    variants = [" ".join(words)]
    while relax and len(words) > VENUE_WORDS and len(variants) < VENUE_TRIES:
        words = words[:-1]
        variants.append(" ".join(words))
    return variants


def clean_date(date: str, year: int = 0) -> str:
    """A date fragment without a bracketed part, the year and punctuation at its ends."""
    cut = date.split("(")[0]
    return (cut.replace(str(year), "") if year else cut).strip(" ,.;:-–—")


def at_venue_date(events: DataFrame, venue: str = "", date: str = "", year: int = 0) -> DataFrame:
    """Events at a venue and date: the first form of the venue that has matches, unless too many match.

    One plan over all forms of the venue, not one query for each.
    """
    date = clean_date(date, year)
    if not venue.strip() and not date:
        return events.where(F.lit(False)).withColumn("variant", F.lit(0))
    variants = venue_variants(venue, relax=bool(date or year))
    at = reduce(lambda rest, i: F.when(holds("venue", variants[i]), i).otherwise(rest), range(len(variants) - 1, -1, -1), F.lit(None))
    conditions = [c for ok, c in ((date, holds("start_date", date)), (year, F.col("year") == year)) if ok]
    found = only(events.withColumn("variant", at.cast("int")).where("variant is not null"), conditions)
    best = found.agg(F.min("variant").alias("_best"), F.count_if(F.col("variant") == F.lit(0)).alias("_n"))
    first = found.join(F.broadcast(best), F.col("variant") == F.col("_best")).drop("_best", "_n")  # one row
    many = first.agg((F.count(F.lit(1)) <= MOST_AT_VENUE).alias("_few"))
    return first.crossJoin(F.broadcast(many)).where("_few").drop("_few")


def merge_vertices(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Upsert: new attributes that are given overwrite, others survive; new keys are added."""
    own = [c for c in stored.columns if c != key]
    old = stored.select(key, *[F.col(c).alias(f"_old_{c}") for c in own])
    joined = old.join(new, key, "full_outer")
    return joined.select(key, *[F.coalesce(c, f"_old_{c}").alias(c) if c in new.columns else F.col(f"_old_{c}").alias(c) for c in own])


def add_edges(stored: DataFrame, new: DataFrame, as_set: bool = False) -> DataFrame:
    """Edges are a bag: adding keeps duplicates, unless a set by (src, dst) is asked for."""
    both = stored.unionByName(new)
    return both.dropDuplicates(["src", "dst"]) if as_set else both


def with_reverse(edges: DataFrame) -> DataFrame:
    """Temporal edges and their mirror: PRECEDES and SUCCEEDS."""
    mirrored = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "time_diff", F.lit("SUCCEEDS").alias("kind"))
    return edges.withColumn("kind", F.lit("PRECEDES")).unionByName(mirrored)


def by_ids(vertices: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Vertices in the order of (pos, key) requests; unknown keys are dropped."""
    return ids.join(vertices, key)


def last_written(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """One value a key: the last in order."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def catalog(events: DataFrame, held_at: DataFrame) -> DataFrame:
    """events with the start_date of the last of their HELD_AT edges (event_id, seq, start_date); an event without one has an empty date."""
    dates = last_written(held_at.where("start_date is not null"), "event_id", "start_date", "seq")
    return events.join(dates, "event_id", "left").withColumn("start_date", F.coalesce("start_date", F.lit("")))


def chronology(events: DataFrame, series: str = "series_id") -> DataFrame:
    """Each event's neighbours in its series and the gap to the previous, else to the next, else 0."""
    by_time = W.partitionBy(series).orderBy("year", "event_date", "event_id")
    prev_year, next_year = F.lag("year").over(by_time), F.lead("year").over(by_time)
    return events.select(
        "event_id",
        F.lag("event_id").over(by_time).alias("prev_event_id"),
        F.lead("event_id").over(by_time).alias("next_event_id"),
        F.coalesce(F.col("year") - prev_year, next_year - F.col("year"), F.lit(0)).alias("time_diff"),
    )


def differences(expected: DataFrame, live: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, column_name, expected, actual) where live attributes differ from the expected; missing keys too."""
    joined = expected.join(live.select(key, *[F.col(c).alias(f"_live_{c}") for c in columns], F.lit(True).alias("_there")), key, "left")
    changed = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("expected"), F.col(f"_live_{c}").cast("string").alias("actual"), (~F.col(c).eqNullSafe(F.col(f"_live_{c}"))).alias("_differs")) for c in columns]
    missing = F.struct(F.lit("(missing)").alias("column_name"), F.lit(None).cast("string").alias("expected"), F.lit(None).cast("string").alias("actual"), F.lit(True).alias("_differs"))
    found = joined.select(key, F.explode(F.when(F.col("_there").isNull(), F.array(missing)).otherwise(F.array(*changed))).alias("d")).select(key, "d.*")
    return found.where("_differs").drop("_differs")
