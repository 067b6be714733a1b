"""Screening of questions, redaction of credentials, and ad-hoc queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LONGEST, MOST_ROWS = 2000, 2500
#: Database commands that a question must not hold.
COMMANDS = (
    "DROP\\s+(GRAPH|TABLE|VERTEX|EDGE|QUERY)\\s+\\w",
    "DELETE\\s+FROM\\s+\\w",
    "CREATE\\s+USER\\s+\\w",
    "TRUNCATE\\s+(TABLE|GRAPH)\\s+\\w",
    "ALTER\\s+(VERTEX|EDGE)\\s+\\w+\\s+(DROP|ADD)\\s+",
    "INSTALL\\s+QUERY\\s+\\w",
    "RUN\\s+SCHEMA_CHANGE\\s+JOB",
)
#: Phrases that try to change what a model was told.
PHRASES = (
    "ignore\\s+(all\\s+)?previous\\s+instructions",
    "system\\s+prompt\\s+(leak|dump|reveal|show)",
    "you\\s+are\\s+now\\s+in\\s+developer\\s+mode",
    "jailbreak\\s+mode",
    "act\\s+as\\s+(dan|evil|unrestricted)\\b",
    "disregard\\s+(all\\s+)?safety\\s+(rules|guidelines|constraints)",
)
#: Credentials.
SECRETS = (
    "AIza[0-9A-Za-z\\-_]{35}",
    "sk-[0-9A-Za-z]{32,}",
    "Bearer\\s+[A-Za-z0-9\\-\\._~\\+\\/]+=*",
    "TG_(?:PASSWORD|SECRET)\\s*=\\s*\\S+",
    "jina_[0-9a-zA-Z]{20,}",
)
REDACTED = "[REDACTED]"


def screened(text: Column, batch: bool = False) -> Column:
    """(ok, reason) of a question; batch runs are trusted."""
    found = lambda patterns: reduce(lambda a, p: a | text.rlike(f"(?i){p}"), patterns, F.lit(False))
    reason = F.when(F.length(text) > LONGEST, "too long").when(found(COMMANDS), "command").when(found(PHRASES), "injection")
    reason = F.lit(None).cast("string") if batch else reason
    return F.struct(reason.isNull().alias("ok"), reason.alias("reason"))


def redacted(text: Column, more: tuple[str, ...] = ()) -> Column:
    """A text without credentials; more patterns may be given."""
    return reduce(lambda t, p: F.regexp_replace(t, p, REDACTED), (*SECRETS, *more), text)


def redacted_all(texts: Column, more: tuple[str, ...] = ()) -> Column:
    """The same within an array of texts."""
    return F.transform(texts, lambda t: redacted(t, more))


def redacted_trace(trace: Column, more: tuple[str, ...] = ()) -> Column:
    """The same for every text of a nested trace (a VARIANT), however deep: done on its JSON text.

    Credentials hold no quotes or brackets that structure JSON, but for those that run to the next
    space; these stop at a quote here, so that the result is JSON again.
    """
    within = [p.replace("\\S+", '[^\\s"]+') for p in (*SECRETS, *more)]
    return F.parse_json(reduce(lambda t, p: F.regexp_replace(t, p, REDACTED), within, F.to_json(trace)))


def double_quoted(query: Column) -> Column:
    """A query with complete single-quoted literals in double quotes; one with a double quote, a backslash or an odd quote stays."""
    quotes = F.length(query) - F.length(F.replace(query, F.lit("'"), F.lit("")))
    plain = (quotes % 2 == 0) & ~F.contains(query, F.lit('"')) & ~F.contains(query, F.lit("\\"))
    return F.when(plain, F.replace(query, F.lit("'"), F.lit('"'))).otherwise(query)


def ad_hoc(spark: SparkSession, text: str, tables: dict[str, DataFrame]) -> DataFrame:
    """The first MOST_ROWS rows of a query text that names its tables in braces, as in ``select count(*) from {events}``.

    A convenience and no protection: the text can also name whatever else the session's catalog holds. Who must not see
    a table needs a session without it, or the catalog's access rights.
    """
    return spark.sql(text, **tables).limit(MOST_ROWS)


def call_key(tool: str, arguments: Column) -> Column:
    """Key under which a repeated call is answered from memory: the tool and its arguments (a map) in order of name."""
    pairs = F.array_sort(F.transform(F.map_entries(arguments), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return F.sha2(F.concat_ws("|", F.lit(tool), F.array_join(pairs, "&")).cast("binary"), 256)
