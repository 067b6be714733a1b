"""Periodic runs of words, found by a suffix automaton whose last occurrences are kept by link-cut access.

Run. A stretch of consecutive words with smallest period q (words q apart are equal) that no
neighbouring word extends, at least LEAST words and TIMES periods long.

Method. Words are appended to a suffix automaton one by one. Every state carries the place at which
its strings were last seen; the states on the path from the whole prefix to the root are the ones
seen at the present place, so an append recolours that path. The suffix-link tree is held as
preferred paths in splay trees, each of one colour: an access meets the path as a few segments, each
with its previous end. A segment whose longest string has l words and that was seen d words ago is a
square where d <= l, more generally a stretch of l + d words with smallest period d; stretches
of the same start and period at successive places are one run, which ends where they do. The number of
segments is logarithmic per append, amortised, also for one word repeated throughout.

Before it, the words are narrowed to where a run can be: after its first period every word of a run
was last seen at most q words ago, so for each power of two K only stretches of words seen at most K
words ago that are long enough for a period above K / 2 count, with K words before them. Nothing else
can hold a run; no run is lost.

Each document is work of its own: no shuffle, memory in proportion to one text.

Defined cases. Null and empty texts, texts of spaces only: no words, no runs, collapsed text empty.
Null ids: rows like others; where an id is hashed, a null one counts as empty text. Repeated rows:
each its result. Very long texts: whole. Empty table: no rows. Extra columns stay, but for those
named ``runs`` and ``collapsed``, which are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventgraph.llm.common import CRC32_TABLE_SQL, arrow_map, columns_of, crc32_sql, text_or_empty, utf8_views, without

LEAST, TIMES = 6, 4


def places(ids: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint stretches (from, to) of word numbers that hold every run."""
    n = len(ids)
    if n < LEAST:
        return []
    order = np.argsort(ids, kind="stable")
    ranked = ids[order]
    back = np.full(n, n, np.int64)  # how many words ago a word was last seen
    same = np.flatnonzero(ranked[1:] == ranked[:-1])
    back[order[same + 1]] = order[same + 1] - order[same]
    found, k = [], 1
    while True:
        near = np.zeros(n + 2, np.int8)
        near[1:-1] = back <= k
        edges = np.flatnonzero(near[1:] != near[:-1])
        begins, ends = edges[::2], edges[1::2]
        enough = ends - begins >= max((TIMES - 1) * (k // 2 + 1), LEAST - k)
        found += zip((begins[enough] - k).clip(0).tolist(), ends[enough].tolist())
        if TIMES * k >= n:
            break
        k *= 2
    merged: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if merged and a <= merged[-1][1]:
            merged[-1] = merged[-1][0], max(b, merged[-1][1])
        else:
            merged.append((a, b))
    return merged


def repeats(ids: list[int]) -> dict[tuple[int, int], int]:
    """(start, period) of each run of ids, and the place of its last word."""
    room = 2 * len(ids) + 2
    after: list[dict[int, int]] = [{}, {}]  # state 1 is the root, 0 is none
    link, length = [0] * room, [0] * room
    left, right, up, seen = [0] * room, [0] * room, [0] * room, [-room] * room  # splay trees, colour at the top of each
    ends: dict[tuple[int, int], int] = {}

    def splay(x: int) -> None:
        while True:
            y = up[x]
            if not y or (left[y] != x and right[y] != x):
                return
            z = up[y]
            inner = z and (left[z] == y or right[z] == y)
            if inner:
                turned = (y, x) if (left[z] == y) == (left[y] == x) else (x, x)
            else:
                seen[x] = seen[y]
                turned = (x,)
            for v in turned:
                p = up[v]
                g = up[p]
                if left[p] == v:
                    c = left[p] = right[v]
                    right[v] = p
                else:
                    c = right[p] = left[v]
                    left[v] = p
                if c:
                    up[c] = p
                if g:
                    if left[g] == p:
                        left[g] = v
                    elif right[g] == p:
                        right[g] = v
                up[v], up[p] = g, v
            if inner and not (up[x] and (left[up[x]] == x or right[up[x]] == x)):
                seen[x] = seen[z]

    whole, top = 1, 1
    for i, word in enumerate(ids):
        top += 1
        new, p = top, whole
        length[new] = length[whole] + 1
        after.append({})
        while p and word not in after[p]:
            after[p][word] = new
            p = link[p]
        if not p:
            link[new] = 1
        else:
            q = after[p][word]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                top += 1
                twin = top
                length[twin] = length[p] + 1
                after.append(dict(after[q]))
                link[twin] = link[q]
                while p and after[p].get(word) == q:
                    after[p][word] = twin
                    p = link[p]
                link[q] = link[new] = twin
                splay(q)  # the twin comes right above q on its path, with q's colour
                above = left[q]
                left[twin] = above
                if above:
                    up[above] = twin
                left[q], up[twin] = twin, q
        whole = new
        up[new] = link[new]
        below, x = 0, new
        while x:
            splay(x)
            ago, longest, under = i - seen[x], length[x], right[x]
            if under:
                seen[under] = seen[x]  # what hangs below keeps its colour
            if (TIMES - 1) * ago <= longest and longest + ago >= LEAST:
                ends[seen[x] - longest + 1, ago] = i
            right[x] = below
            below, x = x, up[x]
        seen[below] = i
    return ends


def runs_of(ids: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of numbered words, by start, then period."""
    found = []
    for a, b in places(np.asarray(ids, np.int64)):
        found += [(a + start, end - start + 1, period) for (start, period), end in repeats(ids[a:b]).items()]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words but those that a run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()])


def find_runs(df: DataFrame, text: str = "text") -> DataFrame:
    """df with runs (start, length, period), by start and period, and its text collapsed to first periods."""
    columns_of(df, text)
    df = without(df, "runs", "collapsed")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), "runs array<struct<start:bigint,length:bigint,period:bigint>>", "collapsed string"])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, short = [], []
        for data in utf8_views(batch.column(batch.schema.get_field_index(text))):
            words, number = data.tobytes().split(), {}
            ids = [number.setdefault(w, len(number)) for w in words]
            # each run has words that come TIMES times at least
            runs = runs_of(ids) if len(ids) - len(number) >= min(TIMES - 1, LEAST - 1) else []
            found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
            short.append(collapsed(words, runs))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind), pa.array(short, pa.binary()).cast(pa.string())], [*batch.schema.names, "runs", "collapsed"])

    return arrow_map(df, work, schema)


def planted(doc_id: Column, text: Column) -> Column:
    """The text; for ids whose CRC-32 is a multiple of ten, with its words repeated from a place on with a period, both read from that number."""
    h = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    rows = F.struct(words.alias("words"), F.size(words).cast("long").alias("n"))

    def periodic(x: Column) -> Column:
        a = F.when(x["n"] > 0, g % F.greatest(x["n"], F.lit(1))).otherwise(0)
        p = 1 + F.floor((x["n"] - a) / (3 + g % 8))
        return F.array_join(F.transform(x["words"], lambda w, i: F.when(i < a, w).otherwise(F.element_at(x["words"], (a + (i - a) % p + 1).cast("int")))), " ")

    return F.when(h % 10 == 0, F.transform(F.array(rows), periodic)[0]).otherwise(text)


def op12_periodic_runs(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = find_runs(docs.select("doc_id", planted(F.col("doc_id"), text_or_empty("text")).alias("text")))
    rank = lambda r: F.struct((r["length"] / r["period"]).alias("times"), (-r["start"]).alias("start"), (-r["period"]).alias("period"), r["length"].alias("length"))
    best = F.array_max(F.transform("runs", rank))  # quotients of numbers below 2 ** 26 differ where fractions do
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    rows = found.select("doc_id", "runs", best.alias("best"), sha(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.period")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


OP12_SQL = f"""
with crc as ({CRC32_TABLE_SQL}),
d as (select row_number() over () rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') ws, coalesce({crc32_sql("doc_id::varchar", "crc")}, 0) h from documents, crc),
k as (select rid, doc_id, ws, h, len(ws) n, case when len(ws) > 0 then (h // 10) % len(ws) else 0 end a from d),
s as (select *, 1 + (n - a) // (3 + (h // 10) % 8) p from k),
t as (select rid, doc_id, n, case when h % 10 = 0 then list_transform(range(n), lambda i: case when i < a then ws[i + 1] else ws[a + (i - a) % p + 1] end) else ws end ws from s),
w as (select rid, n, unnest(ws) word, generate_subscripts(ws, 1) - 1 i from t),
e as (select y.rid, y.i - x.i q, y.i i from w x join w y on x.rid = y.rid and x.word = y.word and x.i < y.i and 4 * (y.i - x.i) <= x.n),
g as (select rid, q, i, i - row_number() over (partition by rid, q order by i) island from e),
c as (select rid, q, min(i) - q s, count(*) + q l from g group by rid, q, island having count(*) + q >= greatest(6, 4 * q)),
r as (select * from c where not exists (select 1 from c o where o.rid = c.rid and o.q < c.q and o.s <= c.s and o.s + o.l >= c.s + c.l)),
b as (select rid, count(*) n_runs, sha256(string_agg(s || ',' || l || ',' || q || chr(10), '' order by s, q)) runs_sha256,
  arg_min({{'s': s, 'l': l, 'q': q}}, (-l::double / q, s, q)) best from r group by rid),
o as (select rid, sha256(string_agg(word, ' ' order by i)) collapsed_sha256 from w
  where not exists (select 1 from r where r.rid = w.rid and w.i >= r.s + r.q and w.i < r.s + r.l) group by rid)
select doc_id, coalesce(n_runs, 0)::bigint n_runs, best.s::bigint "start", best.l::bigint length, best.q::bigint period, (1000 * best.l // best.q)::bigint exponent_milli,
  coalesce(runs_sha256, sha256('')) runs_sha256, coalesce(collapsed_sha256, sha256('')) collapsed_sha256
from t left join b using (rid) left join o using (rid)"""
