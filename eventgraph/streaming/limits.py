"""A rate cap with feedback: an hour's cap for each client and a day's cap for all of them together.

A request is accepted if fewer than per_hour of its client's requests were accepted within the last 3,600 seconds, and fewer
than per_day of all clients' on its UTC day; what is refused counts towards neither. A cap of 0 is off. Order is that of
time, then request_id.

Because refusals feed back, no window aggregate can express it, and because the day's cap is one for all,
no walk of one client alone either. But the day's cap only ever cuts a day short: up to the request that uses it up it
changes nothing, after it all are refused. So clients are walked one by one, each in order of time, and
the accepted requests of each day are numbered over the cluster to find where the day is used up. A cut changes what
its clients carry over midnight, so those that lost a request in the last hour of a day are walked again under the cuts
found, until no cut moves; the first day is right after the first round, and each round makes at least one more right.

Only a walk's state is held: an hour's accepted times of one client. No task holds all requests or all of a
client's, and one row a day reaches the driver.

Defined cases. Null client: a client of its own. Null time: refused, counts nothing. Repeated rows with equal ids are
requests of their own, in any order. Empty table: no rows. Extra columns do not matter.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from eventgraph.operators.ordering import numbered, settled

PER_HOUR, PER_DAY, HOUR, DAY = 20, 100, 3600.0, 86400
#: The last request that a day's cap lets through: none yet.
_OPEN = (float("inf"), 0)


class Walk:
    """One client's accepted times of the last hour, in the days before and on the present day as if it had no cut."""

    def __init__(self, per_hour: int, times: list[float] = ()):
        self.per_hour, self.times, self.day, self.kept = per_hour, deque(times), None, None

    def admit(self, at: float, request: int, last: tuple[float, int]) -> tuple[bool, bool]:
        """Whether the hour lets a request through, and whether its day does too, last being the day's last accepted request."""
        day = at // DAY
        if day != self.day:
            if self.kept is not None:  # what a cut refused was never accepted
                self.times = self.kept
            self.day, self.kept = day, None
        inside = (at, request) <= last
        if not inside and self.kept is None:
            self.kept = deque(self.times)
        while self.times and self.times[0] <= at - HOUR:
            self.times.popleft()
        hour = not self.per_hour or len(self.times) < self.per_hour
        if hour and self.per_hour:
            self.times.append(at)
        return hour, hour and inside


def _walked(rows: DataFrame, per_hour: int) -> DataFrame:
    """rows (client, day, at, request_id, last_at, last_id) with hour and accepted, each client in order of time."""
    kind = rows.schema["client"].dataType.simpleString()
    dealt = rows.repartition("client").sortWithinPartitions("client", "at", "request_id")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, walk = None, None
        for part in batches:
            hours, accepted = [], []
            last_at = part["last_at"].fillna(_OPEN[0])
            for c, at, r, la, li in zip(part["client"].astype(object).where(part["client"].notna(), None), part["at"], part["request_id"], last_at, part["last_id"].fillna(0).astype("int64")):
                if walk is None or c != client:
                    client, walk = c, Walk(per_hour)
                h, a = walk.admit(at, r, (la, li))
                hours.append(h)
                accepted.append(a)
            yield pd.DataFrame({"request_id": part["request_id"], "client": part["client"], "day": part["day"], "at": part["at"], "hour": hours, "accepted": accepted})

    return dealt.mapInPandas(work, f"request_id long, client {kind}, day long, at double, hour boolean, accepted boolean")


def _cuts(walked: DataFrame, per_day: int) -> DataFrame:
    """(day, last_at, last_id): the request that uses a day up, of each day that is."""
    through = numbered(walked.where("hour").select("day", "at", "request_id"), "day", "at", "request_id", into="place")
    first = through.groupBy("day").agg(F.min("place").alias("first"))
    return through.join(first, "day").where(F.col("place") - F.col("first") == per_day - 1).select("day", F.col("at").alias("last_at"), F.col("request_id").alias("last_id"))


def capped(requests: DataFrame, per_hour: int = PER_HOUR, per_day: int = PER_DAY) -> DataFrame:
    """(request_id, client, accepted) of requests (request_id, client, at in seconds)."""
    spark = requests.sparkSession
    rows = settled(requests.select("request_id", "client", F.col("at").cast("double").alias("at")).withColumn("day", F.floor(F.col("at") / DAY).cast("long")))
    timed = rows.where("at is not null")
    schema = "day long, last_at double, last_id long"
    cuts = spark.createDataFrame([], schema)
    walked = settled(_walked(timed.join(cuts, "day", "left"), per_hour))
    while per_day > 0:
        found = sorted(tuple(r) for r in _cuts(walked, per_day).collect())  # one row a day
        if found == sorted(tuple(r) for r in cuts.collect()):
            break
        cuts = spark.createDataFrame(found, schema)
        under = walked.join(cuts, "day", "left")
        inside = F.col("last_at").isNull() | (F.struct("at", "request_id") <= F.struct("last_at", "last_id"))
        now = settled(under.withColumn("now", F.col("hour") & inside))
        # who carries something else over midnight than in the walk before
        moved = now.where((F.col("now") != F.col("accepted")) & (F.col("at") > (F.col("day") + 1) * DAY - HOUR)).select(F.col("client").alias("_c")).distinct()
        if per_hour:
            again = timed.join(moved, F.col("client").eqNullSafe(F.col("_c")), "left_semi")
            stay = now.join(moved, F.col("client").eqNullSafe(F.col("_c")), "left_anti").select("request_id", "client", "day", "at", "hour", F.col("now").alias("accepted"))
            walked = settled(stay.unionByName(_walked(again.join(cuts, "day", "left"), per_hour)))
        else:
            walked = now.select("request_id", "client", "day", "at", "hour", F.col("now").alias("accepted"))
    untimed = rows.where("at is null").select("request_id", "client", F.lit(False).alias("accepted"))
    return walked.select("request_id", "client", "accepted").unionByName(untimed)


def snapshot(requests: DataFrame, decisions: DataFrame, now: float, per_hour: int = PER_HOUR, per_day: int = PER_DAY) -> DataFrame:
    """One row about a time: day, spent_today of all clients, both caps and visitors_last_hour."""
    accepted = decisions.where("accepted").join(requests.select("request_id", "at"), "request_id").where(F.col("at") <= now)
    today = F.floor(F.col("at") / DAY) == int(now // DAY)
    visitors = F.count_distinct(F.when(F.col("at") > now - HOUR, F.struct("client")))
    return accepted.agg(F.count_if(today).alias("spent_today"), visitors.alias("visitors_last_hour")).select(F.to_date(F.timestamp_seconds(F.lit(now))).alias("day_utc"), "spent_today", F.lit(per_day).alias("daily_cap"), F.lit(per_hour).alias("hourly_cap_per_visitor"), "visitors_last_hour")


class HourProcessor(StatefulProcessor):
    """The hour's cap of each client over a stream, for transformWithStateInPandas; idle state can expire after an hour."""

    def __init__(self, per_hour: int = PER_HOUR, expire: bool = True):
        self.per_hour, self.expire = per_hour, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("hour", "times array<double>", ttlDurationMs=3_600_000 if self.expire else None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        walk = Walk(self.per_hour, *(self.state.get() if self.state.exists() else ()))
        batch = pd.concat(list(rows)).sort_values(["at", "request_id"])
        hour = [walk.admit(t, r, _OPEN)[0] for t, r in zip(batch["at"], batch["request_id"])]
        self.state.update((list(walk.times),))
        yield pd.DataFrame({"request_id": batch["request_id"], "client": batch["client"], "at": batch["at"], "accepted": hour})

    def close(self) -> None:
        pass


class DayProcessor(StatefulProcessor):
    """The day's cap over a stream of what the hour lets through, keyed by day: its state is one count."""

    def __init__(self, per_day: int = PER_DAY, expire: bool = True):
        self.per_day, self.expire = per_day, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("day", "spent long", ttlDurationMs=2 * 86_400_000 if self.expire else None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        spent = self.state.get()[0] if self.state.exists() else 0
        batch = pd.concat(list(rows)).sort_values(["at", "request_id"])
        accepted = []
        for hour in batch["accepted"]:
            ok = bool(hour) and (not self.per_day or spent < self.per_day)
            spent += ok
            accepted.append(ok)
        self.state.update((spent,))
        yield pd.DataFrame({"request_id": batch["request_id"], "client": batch["client"], "accepted": accepted})

    def close(self) -> None:
        pass


def capped_stream(requests: DataFrame, per_hour: int = PER_HOUR, expire: bool = True) -> DataFrame:
    """(request_id, client, at, accepted) by the hour's cap of each client, over a stream; needs the RocksDB state store.

    The day's cap of all is ``day_capped_stream``, over these rows. A request that it refuses has counted for its
    client's hour by then: two operators of a stream cannot feed each other back, as ``capped`` does over a table.
    With ``expire`` the query keeps running to drop idle state; without, it can end when all is read.
    """
    mode = "processingTime" if expire else "none"
    return requests.groupBy("client").transformWithStateInPandas(HourProcessor(per_hour, expire), "request_id long, client long, at double, accepted boolean", "Append", mode)


def day_capped_stream(decided: DataFrame, per_day: int = PER_DAY, expire: bool = True) -> DataFrame:
    """(request_id, client, accepted) by the day's cap, over a stream of rows decided by the hour; a day's rows are one key."""
    mode = "processingTime" if expire else "none"
    keyed = decided.withColumn("day", F.floor(F.col("at") / DAY))
    return keyed.groupBy("day").transformWithStateInPandas(DayProcessor(per_day, expire), "request_id long, client long, accepted boolean", "Append", mode)
