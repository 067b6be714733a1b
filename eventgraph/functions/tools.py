"""The tools over an event graph as table functions of SQL, each with its declared columns.

They are SQL functions, not Python ones: Spark puts their bodies into the query that calls them, so filters and columns
reach the scan and no row leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from eventgraph.functions import text

VIEW = "tool_events"
#: Name, parameters, columns and body of each function.
TOOLS = {
    "count_events": ("above int", "sport string, year int, n bigint", "select sport, year, sum(hit) from (select sport, year, coalesce(cast(competitor_count > above as bigint), 0) hit from {view}) group by sport, year"),
    "leading_events": ("most boolean", "sport string, year int, event_id bigint, competitor_count bigint, n_tied bigint", "select sport, year, event_id, competitor_count, count(*) over (partition by sport, year) from (select *, rank() over (partition by sport, year order by o) k from (select *, case when most then -competitor_count else competitor_count end o from {view} where competitor_count > 0)) where k = 1"),
    "events_at": ("place string, on string", "event_id bigint, name string", "select event_id, name from {view} where compact_text(venue) = compact_text(place) and (on is null or start_date = on)"),
    "find_events": ("s string, y int, g string", "event_id bigint, name string", "select event_id, name from {view} where (s is null or sport = s) and (y is null or year = y) and (g is null or gender = g)"),
}


def register(events: DataFrame) -> None:
    """Make the tools and the text functions known to the session of events; they read these events until registered again."""
    spark = events.sparkSession
    text.register(spark)
    events.createOrReplaceTempView(VIEW)
    for name, (parameters, columns, body) in TOOLS.items():
        spark.sql(f"create or replace temporary function {name}({parameters}) returns table({columns}) return {body.format(view=VIEW)}")


def missing(required: set[str], present: set[str]) -> list[str]:
    """The required queries that are not there."""
    return sorted(required - present)
