"""Text normalisation as column expressions.

``normalize`` is exact for any text (NFKD, then ASCII only) and runs as an Arrow UDF; ``ascii_fold``
is the same for all characters of the basic plane, stays in the JVM, and is what the large scans use.
It does no more than a text needs: plain ASCII stays as it is; letters that decompose to one sign
are translated; those that decompose to several (ligatures, fractions, units) are looked up sign by
sign, in the few texts that hold one, which a test of a few wide ranges and then one of the exact ranges find.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _decomposed() -> tuple[dict[str, str], dict[str, str]]:
    """Characters beyond ASCII that decompose to one ASCII sign, and to several."""
    one, several = {}, {}
    for point in range(0xA0, 0xFFFE):
        if 0xD800 <= point < 0xE000:
            continue
        plain = unicodedata.normalize("NFKD", chr(point)).encode("ascii", "ignore").decode()
        if plain:
            (one if len(plain) == 1 else several)[chr(point)] = plain
    return one, several


def _ranges(signs, gap: int) -> str:
    """A character class that holds the signs, and what lies between signs at most gap apart."""
    parts: list[list[int]] = []
    for point in sorted(map(ord, signs)):
        if parts and point - parts[-1][1] <= gap:
            parts[-1][1] = point
        else:
            parts.append([point, point])
    return "[" + "".join(f"\\u{a:04X}-\\u{b:04X}" for a, b in parts) + "]"


_ONE, _SEVERAL = _decomposed()
_MAYBE_SEVERAL, _ANY_SEVERAL = _ranges(_SEVERAL, 4096), _ranges(_SEVERAL, 1)
_BEYOND_ASCII = "[^\\x00-\\x7F]"
#: Typographic signs and what they stand for in names and titles.
_SIGNS = {"‘": "'", "’": "'", "ʼ": "'", "“": '"', "”": '"', "–": "-", "—": "-", "−": "-", " ": " "}
#: Months by number.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


@F.pandas_udf(StringType())
def normalize(texts: pd.Series) -> pd.Series:
    """NFKD, characters beyond ASCII dropped, ends stripped; null stays null."""
    return texts.map(lambda t: unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().strip(), na_action="ignore")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated a single time however often it is used."""
    return F.transform(F.array(value), use)[0]


def ascii_fold(text: Column) -> Column:
    """Characters decomposed, everything beyond ASCII dropped, ends stripped."""
    signs = F.str_to_map(F.lit("\n".join(f"{c}\t{plain}" for c, plain in _SEVERAL.items())), F.lit("\n"), F.lit("\t"))
    spelled = lambda t: F.array_join(F.transform(F.split(t, ""), lambda c: F.coalesce(F.try_element_at(signs, c), c)), "")
    whole = lambda t: F.when(t.rlike(_MAYBE_SEVERAL) & t.rlike(_ANY_SEVERAL), spelled(t)).otherwise(t)
    plain = lambda t: F.regexp_replace(F.translate(whole(t), "".join(_ONE), "".join(_ONE.values())), _BEYOND_ASCII, "")
    return once(text, lambda t: F.trim(F.when(t.rlike(_BEYOND_ASCII), plain(t)).otherwise(t)))


def search_text(text: Column) -> Column:
    """What the index sees: folded, lower case, other signs as single spaces.

    Dashes beyond ASCII are dropped by folding before signs become spaces, so a word pair joined by
    one is a single word here.
    """
    return F.trim(F.regexp_replace(F.lower(ascii_fold(text)), "[^a-z0-9]+", " "))


def search_tokens(text: Column) -> Column:
    return F.filter(F.split(search_text(text), " "), lambda t: t != "")


def fold(text: Column) -> Column:
    """What names are compared by: typographic signs mapped first, so that dashes part words; ``+`` is a word."""
    signs = F.translate(text, "".join(_SIGNS), "".join(_SIGNS.values()))
    lowered = F.lower(ascii_fold(signs))
    spelled = F.replace(F.replace(lowered, F.lit("'"), F.lit("")), F.lit("+"), F.lit(" plus "))
    return F.trim(F.regexp_replace(spelled, "[^a-z0-9]+", " "))


def compact(text: Column) -> Column:
    return F.replace(fold(text), F.lit(" "), F.lit(""))


def stem(token: Column) -> Column:
    """A final s off words of more than three letters that do not end in ss."""
    return F.when((F.length(token) > 3) & token.endswith("s") & ~token.endswith("ss"), F.substr(token, F.lit(1), F.length(token) - 1)).otherwise(token)


def tokens(text: Column) -> Column:
    """The distinct stemmed words of a folded text."""
    return F.array_distinct(F.transform(F.filter(F.split(fold(text), " "), lambda t: t != ""), stem))


def date_keys(text: Column) -> Column:
    """(days, months, years): sorted distinct numbers of up to two digits, month names and four-digit years.

    An ISO date within the text counts as its day, month name and year.
    """
    marked = F.regexp_replace(text, "\\b(\\d{4})-0?(\\d{1,2})-0?(\\d{1,2})\\b", "$3 isomonth$2 $1")
    names = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (f"isomonth{i}", m)])
    words = F.transform(F.split(fold(marked), " "), lambda w: F.coalesce(F.try_element_at(names, w), F.regexp_replace(w, "^isomonth", "")))
    pick = lambda keep: F.array_sort(F.array_distinct(F.filter(words, keep)))
    return F.struct(pick(lambda w: w.rlike("^[0-9]{1,2}$")).alias("days"), pick(lambda w: w.isin(*MONTHS)).alias("months"), pick(lambda w: w.rlike("^[0-9]{4}$")).alias("years"))


def not_found(text: Column) -> Column:
    """Whether an answer says that the corpus has none."""
    return text.rlike("(?i)^not found in corpus\\.?$")


def approximate_tokens(text: Column) -> Column:
    """A quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def paced_tokens(text: Column) -> Column:
    """A third of the characters, rounded up, as requests are paced by."""
    return F.floor((F.length(text) + 2) / 3).cast("long")


def register(spark) -> None:
    """The text functions for use in SQL text: normalize_text, search_text, fold_text and compact_text."""
    spark.udf.register("normalize_text", normalize)
    signs = "translate(t, '" + "".join(_SIGNS).replace("'", "''") + "', '" + "".join(_SIGNS.values()).replace("'", "''") + "')"
    spelled = f"replace(replace(lower(normalize_text({signs})), '\\'', ''), '+', ' plus ')"
    bodies = {"search_text": "trim(regexp_replace(lower(normalize_text(t)), '[^a-z0-9]+', ' '))", "fold_text": f"trim(regexp_replace({spelled}, '[^a-z0-9]+', ' '))", "compact_text": f"regexp_replace({spelled}, '[^a-z0-9]+', '')"}
    for name, body in bodies.items():
        spark.sql(f"create or replace temporary function {name}(t string) returns string return {body}")
