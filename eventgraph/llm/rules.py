"""Quality rules whose cutoffs come with a guarantee against rejecting good documents.

Counts. For each text: words, code points in words, symbols, capitals, lines with a word and those
that repeat an earlier line, words in three-word windows that occur more than once.

Rules. Each compares a ratio of two counts with a cutoff; a document is rejected if one ratio is
above its cutoff. The cutoffs of all rules tighten together in LEVELS steps, loosest first.

Guarantee. Per stratum (language), a labelled holdout says how many of its n good documents a level
rejects (k). A level is certified if the exact one-sided binomial (Clopper-Pearson) upper bound of
the false rejection rate is at most ``risk``, that is if P(Bin(n, risk) <= k) <= confidence share.
Levels are tested loosest first and testing stops at the first that fails, so a stratum spends its
error probability once; strata share ``error`` equally (Bonferroni). With probability 1 - error no
stratum's chosen level rejects more than ``risk`` of its good documents. Of the certified levels the
one is chosen that rejects most bad and fewest good labelled documents (difference of shares), the
loosest of equals; a stratum without a certified level that helps rejects nothing.

Defined cases. Null or empty text: no words, so the base rule fails it. Null language: a stratum of
its own. Ids with several labels: good only if all say so. Repeated rows: each gets its verdict.
Languages without labels: nothing but the base rule. Empty tables: no rows. Unlabelled rows get the
verdict of their stratum too. Extra columns are dropped by the query; ``features`` keeps them but for
those with the name of a count, which are replaced.
"""

from __future__ import annotations

from math import exp, lgamma, log, log1p

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventgraph.llm import words
from eventgraph.llm.common import arrow_map, columns_of, reliable, utf8_views, without

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")
#: Rule: what is counted, against what, and its cutoffs in thousandths, loosest first.
RULES = {
    "symbols": ("n_symbols", "n_words", (2500, 2000, 1500, 1000, 800, 600, 400, 300, 200, 150)),
    "capitals": ("n_capitals", "word_chars", (900, 800, 700, 600, 500, 400, 350, 300, 250, 200)),
    "lines": ("n_dup_lines", "n_lines", (950, 900, 850, 800, 700, 600, 500, 400, 300, 250)),
    "repeats": ("n_repeat_words", "n_words", (490, 470, 450, 420, 390, 360, 330, 300, 270, 240)),
    "length": ("word_chars", "n_words", (20000, 18000, 16000, 15000, 14000, 13000, 12000, 11000, 10500, 10000)),
}
LEVELS = 10
RISK, ERROR = 0.05, 0.05
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def counts(data: np.ndarray) -> tuple[int, ...]:
    """COUNTS of one text, given as its UTF-8 bytes."""
    if not len(data):
        return (0,) * len(COUNTS)
    starts, ends = words.word_spans(data)
    n = len(starts)
    view = words.lanes(data)
    inside = ~words.SPACES[data]
    chars = int((inside & ((data & 0xC0) != 0x80)).sum())
    breaks = np.flatnonzero(data == 0x0A)
    first, last = np.r_[0, breaks + 1], np.r_[breaks, len(data)]
    worded = np.searchsorted(starts, last) > np.searchsorted(starts, first)
    first, last = first[worded], last[worded]
    lines = len(first)
    repeated_lines = lines - len(np.unique(words.span_hashes(view, first, last))) if lines > 1 else 0
    repeated = 0
    if n > 3:
        threes = words.windows(words.span_hashes(view, starts, ends), 3)
        order = np.argsort(threes, kind="stable")
        ranked = threes[order]
        same = ranked[1:] == ranked[:-1]
        if same.any():
            twice = np.zeros(len(threes), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : k + len(twice)] |= twice
            repeated = int(covered.sum())
    capitals = int(((data >= 0x41) & (data <= 0x5A)).sum())
    return n, chars, int(_SYMBOL[data].sum()), repeated_lines, repeated, lines, capitals


def features(df: DataFrame, text: str = "text") -> DataFrame:
    """df without its text and with the COUNTS of each row's text."""
    columns_of(df, text)
    df = without(df, *COUNTS)
    kept = [f for f in df.schema.fields if f.name != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{c} long" for c in COUNTS)])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index(text)
        found = np.array([counts(d) for d in utf8_views(batch.column(at))], np.int64).reshape(batch.num_rows, len(COUNTS))
        others = [i for i in range(batch.num_columns) if i != at]
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in others), *(pa.array(c) for c in found.T)], [*(batch.schema.names[i] for i in others), *COUNTS])

    return arrow_map(df, work, schema)


def strictest(level: int | None = None):
    """The first level (1 is the loosest) at which a rule rejects a row; null if none does."""
    hit = F.lit(None).cast("int")
    for i in reversed(range(LEVELS)):
        above = F.lit(False)
        for counted, against, cutoffs in RULES.values():
            above = above | (1000 * F.col(counted) > cutoffs[i] * F.col(against))
        hit = F.when(above, i + 1).otherwise(hit)
    return hit


def at_most(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k)."""
    return sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p)) for i in range(k + 1))


def certified(n: int, k: int, risk: float, error: float) -> bool:
    """The exact upper bound of a rejection rate, k of n seen, is at most risk."""
    return k < n * risk and at_most(k, n, risk) <= error


def cutoffs(rows: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(lang, level): the level chosen in each labelled stratum; level 0 rejects nothing.

    rows has doc_id, lang and reject_level; labels has doc_id and quality. At most LEVELS + 1 counts
    a stratum are gathered in one group.
    """
    said = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("good"))
    judged = rows.join(said, "doc_id").groupBy("lang", "reject_level").agg(F.sum(F.when(F.col("good") == 1, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("good") == 1, 0).otherwise(1)).alias("bad"))
    strata = judged.agg(F.count_distinct(F.coalesce("lang", F.lit("\0"))).alias("strata"))

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        n_good, n_bad, share = int(group["good"].sum()), int(group["bad"].sum()), error / max(1, int(group["strata"].iloc[0]))
        best, chosen, k, b = 0, 0, 0, 0
        for level in range(1, LEVELS + 1):
            own = group[group["reject_level"] == level]
            k, b = k + int(own["good"].sum()), b + int(own["bad"].sum())
            if not n_good or not certified(n_good, k, risk, share):
                break
            gain = b * n_good - k * n_bad
            if gain > best:
                best, chosen = gain, level
        return pd.DataFrame({"lang": [group["lang"].iloc[0]], "level": [chosen], "n_good": [n_good], "n_bad": [n_bad]})

    return judged.crossJoin(F.broadcast(strata)).groupBy("lang").applyInPandas(choose, "lang string, level int, n_good long, n_bad long")


def verdicts(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """doc_id, lang, the counts, base_failed, level, rejected (by a rule) and kept of each row."""
    columns_of(docs, "doc_id lang text")
    rows = reliable(features(docs.select("doc_id", "lang", "text")).withColumn("reject_level", strictest()))
    chosen = cutoffs(rows, labels, risk, error).select(F.col("lang").alias("_lang"), "level")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    joined = rows.join(chosen, F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang")
    rejected = F.coalesce(F.col("reject_level") <= F.col("level"), F.lit(False))
    return joined.withColumn("base_failed", base).withColumn("rejected", rejected).withColumn("kept", ~F.col("base_failed") & ~F.col("rejected"))


def op9_quality_rules(spark, folder: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    return verdicts(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    level = " ".join("when " + " or ".join(f"1000 * {c} > {cuts[i]} * {a}" for c, a, cuts in RULES.values()) + f" then {i + 1}" for i in range(LEVELS))
    word = "[^ \\t\\n\\x0B\\f\\r]+"
    return f"""
with d as (select row_number() over () rid, doc_id, lang, coalesce(text, '') text from documents),
w as (select rid, regexp_extract_all(text, '{word}') ws from d),
p as (select rid, unnest(ws) word, generate_subscripts(ws, 1) i from w),
t as (select rid, i, word || chr(10) || lead(word) over (partition by rid order by i) || chr(10) || lead(word, 2) over (partition by rid order by i) three from p),
c as (select rid, i, count(*) over (partition by rid, three) n from t where three is not null),
r as (select rid, count(distinct i + k) n_repeat_words from c, (select unnest([0, 1, 2]) k) where n > 1 group by rid),
l as (select rid, unnest(string_split(text, chr(10))) line from d),
l2 as (select rid, count(*) n_lines, count(*) - count(distinct line) n_dup_lines from l where regexp_matches(line, '{word}') group by rid),
f as (select doc_id, lang, len(ws)::bigint n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint n_symbols, coalesce(n_dup_lines, 0)::bigint n_dup_lines,
        coalesce(n_repeat_words, 0)::bigint n_repeat_words, coalesce(n_lines, 0) n_lines, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) n_capitals
      from d join w using (rid) left join r using (rid) left join l2 using (rid)),
g as (select *, case {level} end reject_level from f),
said as (select doc_id, min(quality) good from labels where doc_id is not null and quality is not null group by doc_id),
j as (select lang, coalesce(reject_level, {LEVELS + 1}) lv, good = 1 ok from g join said using (doc_id)),
n as (select lang, count(*) filter (ok) ng, count(*) filter (not ok) nb from j group by lang),
a as (select n.lang, ng, nb, lv, (select count(*) from j where j.lang is not distinct from n.lang and ok and j.lv <= levels.lv) k,
        (select count(*) from j where j.lang is not distinct from n.lang and not ok and j.lv <= levels.lv) b
      from n, (select unnest(range(1, {LEVELS + 1})) lv) levels),
pass as (select *, ng > 0 and k < ng * {RISK} and coalesce(list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(ng + 1) - (case when i = 0 then 0 else lgamma(i + 1) end)
          - (case when ng = i then 0 else lgamma(ng - i + 1) end) + i * ln({RISK}) + (ng - i) * ln(1 - {RISK})))), 0) <= {ERROR} / (select count(*) from n) ok from a),
run as (select *, bool_and(ok) over (partition by lang order by lv) certified, b * ng - k * nb gain from pass),
best as (select lang, arg_min(lv, (-gain, lv)) lv from run where certified and gain > 0 group by lang)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and not coalesce(reject_level <= best.lv, false) kept
from g left join best on g.lang is not distinct from best.lang"""


OP9_SQL = _sql()
