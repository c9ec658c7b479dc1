"""Keyed state that leaves by timers, in lists and maps, with a time to live."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lakeloom.registry import query
from lakeloom.streaming.batch_windows import plain
from lakeloom.streaming.streams import DELAY, ROCKS, drained, events

HOUR = 3_600_000_000
IDLE_SCHEMA = "user_id long, active_from timestamp, idle_from timestamp, n long, spent double"
#: Keys are dealt to so many groups, each with its state and one timer: a call into Python and the state store then serves many keys.
#: A checkpoint holds for one number of groups.
GROUPS = 1024
SPAN = ["unknown", "user_id", "low", "high", "n", "spent"]


class IdleSpans(StatefulProcessor):
    """Active spans of a group's keys, given out by a timer once the watermark is `gap` microseconds past their last event.

    The state is the list of spans that are still open (rows may come in any order until the watermark passes
    them), not the events; a span that was given out leaves it. The group's one timer is that of the span that ends first.
    """

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spans = handle.getListState("spans", "unknown boolean, user_id long, low long, high long, n long, spent double")

    def _timers(self, high: pd.Series) -> pd.Series:
        """Timers are in milliseconds: the first one at or after each span's end."""
        return -(-(high + self.gap) // 1000)

    def _kept(self) -> pd.DataFrame:
        rows = list(self.spans.get()) if self.spans.exists() else []
        return pd.DataFrame(rows, columns=SPAN)

    def _keep(self, spans: pd.DataFrame) -> None:
        if len(spans):
            self.spans.put(list(zip(*(spans[c].tolist() for c in SPAN), strict=True)))
            self.handle.registerTimer(int(self._timers(spans["high"]).min()))
        else:
            self.spans.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 (names of the interface)
        spans = self._kept()
        if len(spans):
            self.handle.deleteTimer(int(self._timers(spans["high"]).min()))
        for frame in rows:
            new = pd.DataFrame({"unknown": frame["unknown"], "user_id": frame["user_id"], "low": frame["at"], "high": frame["at"], "n": 1, "spent": frame["paid"]})
            spans = self._joined(pd.concat([spans, new], ignore_index=True) if len(spans) else new)
        self._keep(spans)
        yield pd.DataFrame()

    def _joined(self, spans: pd.DataFrame) -> pd.DataFrame:
        spans = spans.sort_values(SPAN, ignore_index=True)
        who = spans.groupby(["unknown", "user_id"], sort=False)
        # a span is joined to all that reach it, and not only to the one before it
        reach = who["high"].cummax()
        opens = (who.cumcount() == 0) | (spans["low"] - reach.shift(fill_value=0) >= self.gap)
        by = spans.groupby(opens.cumsum(), sort=False)
        return by.agg({"unknown": "first", "user_id": "first", "low": "first", "high": "max", "n": "sum"}).assign(spent=by["spent"].sum(min_count=1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        spans = self._kept()
        over = self._timers(spans["high"]) <= now
        self._keep(spans[~over])
        ended = spans[over]
        if len(ended):
            utc = lambda v: pd.to_datetime(v, unit="us")
            yield pd.DataFrame({"user_id": ended["user_id"].astype("Int64").mask(ended["unknown"].astype(bool)), "active_from": utc(ended["low"]), "idle_from": utc(ended["high"]), "n": ended["n"], "spent": ended["spent"]})


def idle_spans(stream: DataFrame, gap: int) -> DataFrame:
    """Spans of a stream (user_id, ts with a watermark, at in microseconds, paid) that ended with a silence of `gap` microseconds; no user is a user, too."""
    known = stream.where("at IS NOT NULL").withColumn("unknown", F.col("user_id").isNull()).withColumn("user_id", F.coalesce("user_id", F.lit(0)))
    return known.withColumn("users", F.pmod(F.xxhash64("user_id"), F.lit(GROUPS))).groupBy("users").transformWithStateInPandas(IdleSpans(gap), IDLE_SCHEMA, "Append", "EventTime")


@query(
    "p34_idle_users",
    """WITH marked AS (SELECT user_id, ts, CASE WHEN event_type = 'purchase' THEN value ELSE 0 END AS paid, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS opens
                       FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
            numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM marked),
            spans AS (SELECT user_id, min(ts) AS active_from, max(ts) AS idle_from, count(*) AS n, round(sum(paid), 2) AS spent FROM numbered GROUP BY user_id, s)
       SELECT spans.* FROM spans, (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events) WHERE idle_from + INTERVAL 12 HOUR <= mark""",
)
def idle_users(spark, sf_dir):
    """Users who have been silent for twelve hours: when that is known a timer gives out their last active span, and its state goes."""
    e = events(spark, sf_dir).select("user_id", "ts", F.unix_micros("ts").alias("at"), F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0).alias("paid"))
    out = drained(idle_spans(e.withWatermark("ts", DELAY), 12 * HOUR), conf=ROCKS)
    return out.select("user_id", plain("active_from").alias("active_from"), plain("idle_from").alias("idle_from"), "n", F.round("spent", 2).alias("spent"))


#: With a time to live there is always something to wait for: without this, batches without rows never end.
NO_IDLE_BATCHES = {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}


class KindCounts(StatefulProcessor):
    """How often a key had each kind, as a map; a kind not seen for `ttl` milliseconds (of the cluster's clock) starts anew."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getMapState("counts", "kind string", "n long", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new: dict[str, int] = {}
        for frame in rows:
            for kind, n in frame["kind"].value_counts().items():
                new[kind] = new.get(kind, 0) + int(n)
        for kind in new:
            if self.counts.containsKey((kind,)):
                new[kind] += self.counts.getValue((kind,))[0]
            self.counts.updateValue((kind,), (new[kind],))
        yield pd.DataFrame({"user_id": [key[0]] * len(new), "kind": list(new), "n": list(new.values())})


def kind_counts(stream: DataFrame, ttl: int) -> DataFrame:
    """Running counts of (user_id, kind) as they change."""
    return stream.groupBy("user_id").transformWithStateInPandas(KindCounts(ttl), "user_id long, kind string, n long", "Append", "ProcessingTime")


@query("p34_counts_by_kind", "SELECT user_id, event_type AS kind, count(*) AS n FROM events GROUP BY ALL")
def counts_by_kind(spark, sf_dir):
    """The last count of each user and kind; the state keeps a kind for thirty days."""
    e = events(spark, sf_dir).select("user_id", F.col("event_type").alias("kind"))
    return drained(kind_counts(e, 30 * 86_400_000), conf=ROCKS | NO_IDLE_BATCHES).groupBy("user_id", "kind").agg(F.max("n").alias("n"))
