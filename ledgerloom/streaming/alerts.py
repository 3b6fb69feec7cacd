"""Alert rules: conditions over event time that must hold for a while before they fire.

Every signal becomes rows of changes: ``rule``, ``series``, ``ts`` and either ``delta`` (the level of the rule
rises or falls) or ``above`` (a series is above its limit from now on, or no longer). A rule's condition is true
while its level is positive. It fires once it was true without a break for the rule's hold time and resolves
when the level is back at zero. The batch and the streaming form give the same rows."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# Rules, seconds they must hold, and the lag that is too high.
HOLD_SECONDS = {"http_5xx": 300, "failed_events": 600, "failed_jobs": 600, "consumer_lag": 900}
ERROR_WINDOW_SECONDS, LAG_LIMIT = 300, 100
ALERT = "rule string, started_at timestamp, state string, moment timestamp"


def _changes(rows: DataFrame, rule: str, *changes: Column) -> DataFrame:
    each = rows.select(F.explode(F.array(*changes)).alias("c")).where(F.col("c.ts").isNotNull())
    return each.select(F.lit(rule).alias("rule"), "c.series", F.col("c.ts").cast("timestamp").alias("ts"), "c.delta", "c.above")


def _change(ts: Column, delta: int) -> Column:
    return F.struct(F.lit("").alias("series"), ts.alias("ts"), F.lit(delta).cast("long").alias("delta"), F.lit(None).cast("int").alias("above"))


def error_changes(request: DataFrame) -> DataFrame:
    """A server error counts for the five minutes after it."""
    ts = F.col("ts").cast("timestamp")
    errors = request.where(F.col("status_code") >= 500)
    return _changes(errors, "http_5xx", _change(ts, 1), _change(ts + F.make_dt_interval(secs=F.lit(ERROR_WINDOW_SECONDS)), -1))


def failure_changes(rows: DataFrame, rule: str, failed_at: str, settled_at: str) -> DataFrame:
    """A failed event or job counts from its failure until it is settled; null: never failed, not settled yet."""
    failed = rows.where(F.col(failed_at).isNotNull())
    settled = F.when(F.col(settled_at).isNotNull(), F.greatest(F.col(settled_at), F.col(failed_at)))
    return _changes(failed, rule, _change(F.col(failed_at), 1), _change(settled, -1))


def lag_changes(sample: DataFrame, limit: int = LAG_LIMIT) -> DataFrame:
    """Samples of ``series``, ``ts`` and ``lag``: a series stays above the limit until a sample says otherwise."""
    return sample.select(
        F.lit("consumer_lag").alias("rule"), F.col("series").cast("string").alias("series"), F.col("ts").cast("timestamp").alias("ts"),
        F.lit(None).cast("long").alias("delta"), (F.col("lag") > limit).cast("int").alias("above"))


def _hold(holds: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in holds.items() for x in pair]), F.col("rule"))


def held_conditions(changes: DataFrame, until: str | None = None, holds: dict[str, int] | None = None) -> DataFrame:
    """``firing`` and ``resolved`` rows of all rules, from all changes up to ``until`` (else the last one).

    Changes of one moment are one row per rule before anything is ordered. Levels are running sums inside a day
    plus the sums of the days before, so a rule with most of the rows is spread over its days."""
    holds = holds or HOLD_SECONDS
    rows = changes.where(F.col("ts") <= F.lit(until).cast("timestamp")) if until else changes
    # several samples of a series at one moment: the highest counts
    samples = rows.where(F.col("above").isNotNull()).groupBy("rule", "series", "ts").agg(F.max("above").alias("above"))
    before = F.lag("above", 1, 0).over(W.partitionBy("rule", "series").orderBy("ts"))
    steps = samples.select("rule", "ts", (F.col("above") - before).cast("long").alias("delta"))
    moments = rows.where(F.col("delta").isNotNull()).select("rule", "ts", "delta").unionByName(steps).groupBy("rule", "ts").agg(F.sum("delta").alias("delta"))
    moments = moments.withColumn("day", F.to_date("ts"))
    days = moments.groupBy("rule", "day").agg(F.sum("delta").alias("moved"))
    earlier = days.select("rule", "day", (F.sum("moved").over(W.partitionBy("rule").orderBy("day").rowsBetween(W.unboundedPreceding, 0)) - F.col("moved")).alias("base"))
    inside = F.sum("delta").over(W.partitionBy("rule", "day").orderBy("ts").rowsBetween(W.unboundedPreceding, 0))
    levels = moments.withColumn("inside", inside).join(earlier, ["rule", "day"]).withColumn("level", F.col("inside") + F.col("base"))
    rises, falls = (F.col("level") > 0) & (F.col("level") - F.col("delta") <= 0), (F.col("level") <= 0) & (F.col("level") - F.col("delta") > 0)
    edges = levels.where(rises | falls).select("rule", "ts", (F.col("level") > 0).alias("up"))
    spans = edges.withColumn("ended_at", F.lead("ts").over(W.partitionBy("rule").orderBy("ts"))).where("up").select("rule", F.col("ts").alias("started_at"), "ended_at")
    last = F.lit(until).cast("timestamp") if until else None
    ends = spans if until else spans.join(rows.groupBy("rule").agg(F.max("ts").alias("last__")), "rule")
    fires = F.col("started_at") + F.make_dt_interval(secs=_hold(holds))
    held = ends.withColumns({"fires": fires, "stop": F.coalesce("ended_at", last if until else F.col("last__"))})
    # an end at the very moment of firing comes first; an open condition fires at its moment
    fired = held.where((F.col("fires") < F.col("stop")) | (F.col("ended_at").isNull() & (F.col("fires") <= F.col("stop"))))
    out = F.array(F.struct(F.lit("firing").alias("state"), F.col("fires").alias("moment")), F.struct(F.lit("resolved").alias("state"), F.col("ended_at").alias("moment")))
    return fired.select("rule", "started_at", F.explode(out).alias("o")).select("rule", "started_at", "o.*").where(F.col("moment").isNotNull())


def _micros(ts: pd.Timestamp | datetime) -> int:
    return pd.Timestamp(ts).value // 1000


def _moment(micros: int) -> datetime:
    return datetime.fromtimestamp(micros / 1_000_000, tz=timezone.utc).replace(tzinfo=None)


class HoldProcessor(StatefulProcessor):
    """State of one rule: changes not yet reached by the watermark, level, start, series above their limit.

    Changes wait in a map by moment until the watermark has passed them, so rows may come late and in any order
    within the watermark's delay. Timers wake the rule at waiting moments and at the moment it would fire."""

    def __init__(self, holds: dict[str, int]):
        self.holds = holds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long", "delta long")
        self.samples = handle.getMapState("samples", "at long, series string", "above int")
        self.above = handle.getMapState("above", "series string", "above int")
        # level, start of the condition (-1: false), whether it has fired
        self.own = handle.getValueState("own", "level long, since long, fired boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802,N803 - Spark's names
        moments = set()
        for part in rows:
            part = part.assign(at=[_micros(t) for t in part["ts"]])
            for at, delta in part[part["delta"].notna()].groupby("at")["delta"].sum().items():
                held = self.waiting.getValue((int(at),)) if self.waiting.containsKey((int(at),)) else (0,)
                self.waiting.updateValue((int(at),), (int(held[0]) + int(delta),))
                moments.add(int(at))
            for (at, series), above in part[part["above"].notna()].groupby(["at", "series"])["above"].max().items():
                k = (int(at), str(series))
                held = self.samples.getValue(k) if self.samples.containsKey(k) else (0,)
                self.samples.updateValue(k, (max(int(held[0]), int(above)),))
                moments.add(int(at))
        for at in moments:
            # a timer is due once the watermark is at or beyond its millisecond: rounded up, never too early
            self.handle.registerTimer(-(-at // 1000))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802,N803 - Spark's names
        mark, rule = timerValues.getCurrentWatermarkInMs() * 1000, key[0]
        level, since, fired = self.own.get() if self.own.exists() else (0, -1, False)
        moves: dict[int, int] = {}
        for (at,), (delta,) in list(self.waiting.iterator()):
            if at <= mark:
                moves[at] = moves.get(at, 0) + delta
                self.waiting.removeKey((at,))
        due = sorted((at, series, above) for (at, series), (above,) in list(self.samples.iterator()) if at <= mark)
        for at, series, above in due:
            before = self.above.getValue((series,))[0] if self.above.containsKey((series,)) else 0
            moves[at] = moves.get(at, 0) + above - before
            self.above.updateValue((series,), (above,))
            self.samples.removeKey((at, series))
        hold, out = self.holds[rule] * 1_000_000, []
        for at in sorted(moves):
            if since >= 0 and not fired and since + hold < at:
                fired = True
                out.append((rule, since, "firing", since + hold))
            level += moves[at]
            if level > 0 and since < 0:
                since = at
                self.handle.registerTimer(-(-(at + hold) // 1000))
            elif level <= 0 and since >= 0:
                if fired:
                    out.append((rule, since, "resolved", at))
                since, fired = -1, False
        if since >= 0 and not fired and since + hold <= mark:
            fired = True
            out.append((rule, since, "firing", since + hold))
        self.own.update((level, since, fired))
        if out:
            yield pd.DataFrame([(r, _moment(s), state, _moment(at)) for r, s, state, at in out], columns=["rule", "started_at", "state", "moment"])

    def close(self) -> None:
        pass


def held_stream(changes: DataFrame, delay: str, holds: dict[str, int] | None = None) -> DataFrame:
    """The streaming form of ``held_conditions``; the session needs the RocksDB state store.

    Alerts leave in append mode when the watermark has reached them; rows later than ``delay`` are dropped."""
    stream = changes.withWatermark("ts", delay)
    return stream.groupBy("rule").transformWithStateInPandas(HoldProcessor(holds or HOLD_SECONDS), ALERT, outputMode="Append", timeMode="EventTime")
