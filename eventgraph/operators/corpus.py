"""From a corpus of articles to the vertices and edges of the event graph, as one set of frames."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventgraph.operators import ingest

MEDALS = ("gold", "silver", "bronze")
#: The header's parts in order.
HEADER = {"Year": "year", "Season": "season", "Sport": "sport", "Event": "event_name", "Venue": "venue", "Competitors": "competitor_count", "Nations": "nation_count", "Gold": "gold_athlete", "Silver": "silver_athlete", "Bronze": "bronze_athlete", "Prev Edition": "prev_year", "Next Edition": "next_year"}


def sport_of(title: Column) -> Column:
    """The sport that a title begins with."""
    return F.nullif(F.trim(F.regexp_extract(F.trim(title), ingest.SPORT_TITLE, 1)), F.lit(""))


def games_of(games: Column, title: Column) -> Column:
    """(year, season): those of a title of the grammar, else those that the infobox names."""
    said = F.when(F.lower(games).contains("summer"), "Summer").when(F.lower(games).contains("winter"), "Winter")

    def of(told: Column) -> Column:
        year = F.when(told["year"] != "", told["year"]).otherwise(F.nullif(F.regexp_extract(games, ingest.YEAR, 1), F.lit("")))
        return F.struct(year.cast("int").alias("year"), F.when(told["year"] != "", told["season"]).otherwise(said).alias("season"))

    return ingest.let(ingest.told_games(F.trim(title)), of)


def parsed(docs: DataFrame) -> DataFrame:
    """docs (doc_id, title, text and others) with what their infobox and title say, the filter mask and the header.

    A field that is not there is null; an article without an infobox may still have a sport and Games by its title.
    """
    read = docs.withColumn("_read", ingest.read_box(F.col("text")))
    box = F.struct(*[ingest.box_field(F.col("_read"), name).alias(name) for name in ingest.NAMES])
    field = lambda name: F.col(f"_box.{name}")
    own = read.withColumn("_box", box).withColumn("_games", games_of(F.coalesce(field("games"), F.lit("")), F.col("title"))).withColumn("_sport", sport_of(F.col("title")))
    names = lambda raw: F.array_join(ingest.glued_names(ingest.without_country(raw)), ", ")
    event = F.nullif(F.trim(field("event")), F.lit(""))
    year_in = lambda name: F.nullif(F.regexp_extract(field(name), ingest.YEAR, 1), F.lit("")).cast("int")
    fields = {
        "year": F.col("_games.year"),
        "season": F.col("_games.season"),
        "sport": F.coalesce(F.nullif(field("sport"), F.lit("")), "_sport"),
        "gender": ingest.gender_of(field("gender"), event, F.col("title")),
        "event_name": event,
        "venue": field("venue"),
        "dates": field("dates"),
        "competitor_count": ingest.repaired_count(ingest.first_integer(field("competitors")), F.col("_read.opening")),
        "nation_count": ingest.first_integer(field("nations")),
        **{f"{m}_athlete": names(field(m)) for m in MEDALS},
        **{f"{m}_noc": F.coalesce(field(f"{m}_noc"), ingest.country_code(field(m))) for m in MEDALS},
        "prev_year": year_in("prev"),
        "next_year": year_in("next"),
    }
    told = own.select(*docs.columns, *[c.alias(n) for n, c in fields.items()])
    return told.withColumn("filter_mask", ingest.filter_mask(F.col("year"), F.col("season"))).withColumn("header", header())


def header() -> Column:
    """The parts that are there, named, joined by bars."""
    parts = [F.concat(F.lit(f"{name}: "), F.nullif(F.col(c).cast("string"), F.lit(""))) for name, c in HEADER.items()]
    return F.concat_ws(" | ", F.concat(F.lit("Title: "), "title"), *parts)


def chronology(docs: DataFrame, kept: Sequence[str] = ()) -> DataFrame:
    """(doc_id, prev_event_id, next_event_id, time_diff) of the articles whose titles are of the grammar.

    A series is a sport and an event's name; its articles stand by year, those of one year by id.
    time_diff is the distance to the edition before, or to the next where there is none before. Columns of kept stay.
    """
    title = F.trim("title")
    named = docs.where(title.rlike(ingest.TITLE))
    part = lambda k: F.trim(F.regexp_extract(title, ingest.TITLE, k))
    series = named.select("doc_id", *kept, F.lower(part(1)).alias("_sport"), ingest.subname(part(4)).alias("_name"), part(2).cast("int").alias("_year"))
    order = W.partitionBy("_sport", "_name").orderBy("_year", "doc_id")
    before, after = F.col("_year") - F.lag("_year").over(order), F.lead("_year").over(order) - F.col("_year")
    linked = series.select("doc_id", *kept, F.lag("doc_id").over(order).alias("prev_event_id"), F.lead("doc_id").over(order).alias("next_event_id"), before.alias("_b"), after.alias("_a"))
    return linked.select("doc_id", *kept, "prev_event_id", "next_event_id", F.coalesce(F.nullif("_b", F.lit(0)), "_a", F.lit(0)).alias("time_diff"))


def admitted(articles: DataFrame) -> DataFrame:
    """The articles on events: a year, a season or a sport is known."""
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    return articles.where(given("year") | given("season") | given("sport"))


def event_rows(articles: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Event vertices of parsed articles: unknown texts empty, unknown numbers 0.

    extra may give valid_from, valid_to, superseded_by and source_authority by doc_id.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    given = articles
    if extra is not None:
        given = given.join(extra.select("doc_id", "valid_from", "valid_to", "superseded_by", "source_authority"), "doc_id", "left")
    else:
        given = given.select("*", *[F.lit(None).cast("string").alias(c) for c in ("valid_from", "valid_to", "superseded_by")], F.lit(None).cast("double").alias("source_authority"))
    texts = ["season", "sport", "gender", "venue", *[f"{m}_{k}" for m in MEDALS for k in ("athlete", "noc")], "superseded_by"]
    numbers = ["year", "competitor_count", "nation_count", "filter_mask"]
    return admitted(given).select(F.col("doc_id").alias("event_id"), F.col("title").alias("name"), *map(text, texts), *map(number, numbers), "valid_from", "valid_to", F.coalesce("source_authority", F.lit(1.0)).alias("source_authority"))


def graph_frames(docs: DataFrame) -> dict[str, DataFrame]:
    """All vertices and edges of a corpus by name; give persisted docs if several frames are used.

    Edges have src, dst and, where they carry one, a value.
    """
    articles = parsed(docs)
    cut = ingest.chunks(articles)
    linked = chronology(docs).withColumnRenamed("doc_id", "event_id")
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    events = event_rows(articles).join(linked.drop("time_diff"), "event_id", "left")
    return {
        "documents": articles.select("doc_id", "title", "url", "wikidata_qid", "wikipedia_pageid", "approx_tokens", "filter_mask"),
        "chunks": ingest.stored_chunks(cut.join(articles.select("doc_id", F.col("title").alias("section_title"), "filter_mask"), "doc_id")),
        "events": events.select(*[told(c) if c in ("prev_event_id", "next_event_id") else c for c in events.columns]),
        "has_chunk": cut.select(F.col("doc_id").alias("src"), F.col("chunk_id").alias("dst"), F.lit(None).cast("string").alias("value")),
        **edge_frames(articles),
    }


#: What venues and the edges other than those of chunks are made of.
READ = ("doc_id", "title", "year", "season", "sport", "venue", "dates")


def edge_frames(articles: DataFrame) -> dict[str, DataFrame]:
    """Venues and edges of parsed articles (doc_id and the other columns of READ), by name; give settled ones if several frames are used."""
    known = admitted(articles.select(*READ))
    venue = F.trim("venue")
    held = known.where("venue <> ''").select(F.col("doc_id").alias("src"), ingest.venue_id(venue).alias("dst"), venue.alias("name"), F.coalesce("dates", F.lit("")).alias("value"))
    linked = chronology(articles.select("doc_id", "title", "year", "season", "sport"), kept=("year", "season", "sport"))
    edge = lambda to: admitted(linked).where(F.col(to).isNotNull()).select(F.col("doc_id").alias("src"), F.col(to).alias("dst"), F.col("time_diff").cast("string").alias("value"))
    return {
        "venues": held.groupBy(F.col("dst").alias("venue_id")).agg(F.max_by("name", "src").alias("name")),
        "documented_in": known.select(F.col("doc_id").alias("src"), F.col("doc_id").alias("dst"), F.lit(None).cast("string").alias("value")),
        "held_at": held.select("src", "dst", "value"),
        "precedes": edge("prev_event_id"),
        "succeeds": edge("next_event_id"),
    }


def totals(frames: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of every frame."""
    return reduce(DataFrame.unionByName, [rows.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name, rows in frames.items()])
