"""Trajectory steps on a ping stream with the last ping kept as state.

Two keyed operators follow each other. The first is keyed by (survey, leg of ping numbers), so a busy survey spreads over
its legs: it holds pings until the watermark has passed them, releases them in ping order and pairs each with the ping
released before. The second is keyed by survey and sees two short rows per leg and micro-batch only: a leg's first ping and
its last one so far; it pairs the first ping of a leg with the last ping of the legs before. Finished steps pass through it
by their leg. Gaps in ping numbers and pauses of any length are steps like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sonarlake.functions.geo import KNOTS_PER_MPS, haversine
from sonarlake.operators.pings import MAX_SPEED_KNOTS

LEG = 4096
#: The state store that keyed operators with timers need; a session setting.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
FIX = ["ping_id", "t_s", "latitude", "longitude"]
FIX_SCHEMA = "ping_id bigint, t_s double, latitude double, longitude double"
STEP, FIRST, LAST = 0, 1, 2
OUT = ["kind", "survey_id", "leg", "released", *FIX, *[f"p_{c}" for c in FIX]]
OUT_SCHEMA = ("kind int, survey_id bigint, leg bigint, released timestamp, " + FIX_SCHEMA + ", p_ping_id bigint, p_t_s double, p_latitude double, p_longitude double")
NO_FIX = (None, None, None, None)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=OUT)
    for c in ("ping_id", "p_ping_id"):
        out[c] = pd.array(out[c].tolist(), dtype="Int64")
    return out.astype({c: "float64" for c in OUT[5:8] + OUT[9:]})


class LegSteps(StatefulProcessor):
    """Pings of one leg, released in ping order behind the watermark."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "ids array<bigint>, millis array<bigint>, t array<double>, lat array<double>, lon array<double>")
        self.last = handle.getValueState("last", FIX_SCHEMA)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        done = self.last.get()[0] if self.last.exists() else None
        if done is not None:  # a ping below one already released is late
            new = new[new["ping_id"] > done]
        if len(new):
            cols = [new["ping_id"].tolist(), new["millis"].tolist(), *(new[c].tolist() for c in FIX[1:])]
            if self.held.exists():
                cols = [[*old, *own] for old, own in zip(self.held.get(), cols)]
            self._hold(cols)
        return iter([])

    def _hold(self, cols: list[list]) -> None:
        """Keep the pings in order and wake up when the watermark passes the lowest one."""
        order = np.lexsort((cols[1], cols[0]))
        cols = [[c[i] for i in order] for c in cols]
        self.held.update(tuple(cols))
        self.handle.registerTimer(cols[1][0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.held.exists():
            return
        now = timerValues.getCurrentWatermarkInMs()
        cols = self.held.get()
        n = 0
        while n < len(cols[0]) and cols[1][n] <= now:
            n += 1
        if not n:
            return
        survey, leg, at = key[0], key[1], pd.Timestamp(now, unit="ms")
        before = tuple(self.last.get()) if self.last.exists() else None
        rows = []
        for i in range(n):
            fix = tuple(c[i] for c in (cols[0], *cols[2:]))
            rows.append((FIRST if before is None else STEP, survey, leg, at, *fix, *(before or NO_FIX)))
            before = fix
        rows.append((LAST, survey, leg, at, *before, *NO_FIX))
        self.last.update(before)
        self.held.clear()
        if n < len(cols[0]):
            self._hold([list(c[n:]) for c in cols])
        yield _frame(rows)

    def close(self) -> None:
        pass


class LegBorders(StatefulProcessor):
    """Steps from leg to leg of one survey; rows of finished steps pass through."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", FIX_SCHEMA)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[1] >= 0:
            for batch in rows:
                yield batch[OUT].drop(columns=["released"])
            return
        edges = pd.concat(list(rows), ignore_index=True).sort_values(["ping_id", "kind"])
        last = tuple(self.last.get()) if self.last.exists() else None
        out = []
        for r in edges[OUT].itertuples(index=False):
            fix = (int(r.ping_id), r.t_s, r.latitude, r.longitude)
            if r.kind == FIRST and last is not None and last[0] < fix[0]:
                out.append((STEP, r.survey_id, r.leg, r.released, *fix, *last))
            if last is None or fix[0] > last[0]:
                last = fix
        self.last.update(last)
        if out:
            yield _frame(out).drop(columns=["released"])

    def close(self) -> None:
        pass


def closing_ping(pings: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """One ping that ends a finished recording: of a survey that does not occur, later than the last by more than ``delay``.

    Sent last it moves the watermark past every ping before it, so none is held back; it gives no step of its own.
    """
    last = pings.filter("survey_id IS NOT NULL AND ping_id IS NOT NULL AND ts IS NOT NULL").agg(F.min("survey_id").alias("s"), F.max("ts").alias("ts")).filter("ts IS NOT NULL")
    nowhere = F.lit(None).cast("double")
    return last.select((F.col("s") - 1).alias("survey_id"), F.lit(0).cast("bigint").alias("ping_id"), (F.col("ts") + F.expr(f"INTERVAL {delay}") + F.expr("INTERVAL 1 minute")).alias("ts"),
                       nowhere.alias("t_s"), nowhere.alias("latitude"), nowhere.alias("longitude"))


def stream_trajectory(pings: DataFrame, delay: str = "10 minutes", max_speed_knots: float = MAX_SPEED_KNOTS, leg: int = LEG) -> DataFrame:
    """survey_id, ping_id, dt_s, distance_m, speed_knots, non_monotonic, teleport of every step to the previous ping.

    ``pings`` carries survey_id, ping_id, ts (timestamp), t_s, latitude, longitude. Equals ``trajectory_steps`` on the pings
    whose time the watermark (``delay`` behind the latest) has passed; a ping that comes after a higher-numbered ping of its
    leg was released is late and gives no step. The session must use the state store of ``STORE``. State is one ping per
    leg and survey plus the pings newer than the watermark.
    """
    rows = pings.filter("survey_id IS NOT NULL AND ping_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", delay)
    rows = rows.withColumn("leg", F.floor(F.col("ping_id") / F.lit(float(leg))).cast("bigint")).withColumn("millis", F.ceil(F.unix_micros("ts") / 1000.0).cast("bigint"))
    rows = rows.select("survey_id", "leg", "millis", "ts", *FIX)
    legs = rows.groupBy("survey_id", "leg").transformWithStateInPandas(LegSteps(), OUT_SCHEMA, "append", "EventTime", eventTimeColumnName="released")
    lane = F.when(F.col("kind") == STEP, F.col("leg")).otherwise(F.lit(-1).cast("bigint"))
    joined = legs.withColumn("lane", lane).groupBy("survey_id", "lane").transformWithStateInPandas(
        LegBorders(), OUT_SCHEMA.replace("released timestamp, ", ""), "append", "EventTime")
    dt = F.col("t_s") - F.col("p_t_s")
    metres = haversine(F.col("p_latitude"), F.col("p_longitude"), F.col("latitude"), F.col("longitude"))
    out = joined.select("survey_id", "ping_id", dt.alias("dt_s"), F.when(dt > 0, metres).alias("distance_m"), F.when(dt > 0, metres / dt * KNOTS_PER_MPS).alias("speed_knots"),
                        (dt <= 0).alias("non_monotonic"))
    return out.withColumn("teleport", F.coalesce(F.col("speed_knots") > max_speed_knots, F.lit(False)))
