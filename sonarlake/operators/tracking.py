"""Frame-to-frame association, track histories, forecasts and tracking metrics.

Observations carry (survey_id, track_id, t, x, y, w, h, conf). ``obs_no`` counts a track's observations from 0.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonarlake.config import TrackSettings
from sonarlake.functions.assign import matched_pairs
from sonarlake.plans.durable import durable
from sonarlake.plans.ordered import dense_index, running_sums, with_chunks
from sonarlake.plans.totals import with_totals

POS_SCALE, SIZE_SCALE = 100.0, 100.0
CHUNK = 4096
TRACK = ("survey_id", "track_id")


# ---- association ----------------------------------------------------------------------------------------------------------

Motion = tuple[float, float, float, float, float, float]


def motion(history: Sequence[tuple[float, float, float]], window: int = 3) -> Motion:
    """Last x and y, displacement over the last observations, time of its last step and in all (0: at rest)."""
    obs = history[-(window + 1):]
    (t0, x0, y0), (t, x, y) = obs[0], obs[-1]
    if len(obs) < 2 or t - t0 <= 0:
        return x, y, 0.0, 0.0, 0.0, 0.0
    return x, y, x - x0, y - y0, (t - obs[-2][0]) or 1.0, t - t0


def forecast(history: Sequence[tuple[float, float, float]], step_no: int, window: int = 3) -> tuple[float, float]:
    """Displacement ``step_no`` steps ahead of the last (t, x, y) at the mean velocity of the last observations."""
    _, _, dx, dy, step, span = motion(history, window)
    if not span:
        return 0.0, 0.0
    k = step * step_no / span
    return dx * k, dy * k


class FrameTracker:
    """Association state of one survey: a few live tracks with short histories. ``live`` is plain data for keyed state."""

    def __init__(self, cfg: TrackSettings, live: list[dict] | None = None, next_id: int = 1, frame: int | None = None):
        self.cfg, self.live, self.next_id, self.frame = cfg, live or [], next_id, frame

    def skip_to(self, frame: int) -> None:
        """Frames without detections between the last one and ``frame``: every live track misses them."""
        if self.frame is not None:
            for _ in range(min(frame - self.frame - 1, self.cfg.max_age + 2)):
                self._expire(set())
        self.frame = frame

    def _expire(self, matched: set[int]) -> None:
        for i, tr in enumerate(self.live):
            if i not in matched:
                tr["misses"] += 1
        self.live = [tr for tr in self.live if tr["misses"] <= self.cfg.max_age]

    def update(self, frame: int, xs: np.ndarray, ys: np.ndarray, names: Sequence[str]) -> list[tuple[int, int]]:
        """Track id and hit count per detection of one frame, in input order."""
        self.skip_to(frame)
        cfg, n = self.cfg, len(xs)
        xs, ys = np.asarray(xs, dtype=float), np.asarray(ys, dtype=float)
        px, py = xs.tolist(), ys.tolist()
        result: list[tuple[int, int] | None] = [None] * n
        taken: set[int] = set()
        if self.live and n:
            expect = np.array([self._expected(tr) for tr in self.live])
            dist = np.hypot(expect[:, :1] - xs[None, :], expect[:, 1:] - ys[None, :])
            # a detection's class is free of penalty for tracks of that name, or for all if it is unknown
            code = {name: i for i, name in enumerate(dict.fromkeys(tr["name"] for tr in self.live))}
            mine = np.array([code[tr["name"]] for tr in self.live])
            free = np.array([-2 if "Unknown" in str(d) else code.get(d, -1) if isinstance(d, str) else -1 for d in names])
            other = np.where((mine[:, None] == free[None, :]) | (free == -2)[None, :], 0.0, cfg.class_penalty)
            cost = np.where(dist <= cfg.match_dist_px, dist + other, 1e6)
            allowed = cost < 1e5
            for i, j in matched_pairs(cost, allowed):
                if allowed[i, j]:
                    tr = self.live[i]
                    tr["history"] = (tr["history"] + [(float(frame), px[j], py[j])])[-(cfg.seq_len + cfg.horizon):]
                    tr["motion"] = motion(tr["history"])
                    tr["hits"] += 1
                    tr["misses"] = 0
                    taken.add(i)
                    result[j] = (tr["id"], tr["hits"])
        fresh = []
        for j in range(n):
            if result[j] is None:
                fresh.append({"id": self.next_id, "name": str(names[j]), "history": [(float(frame), px[j], py[j])], "hits": 1, "misses": 0})
                result[j] = (self.next_id, 1)
                self.next_id += 1
        self._expire(taken)
        self.live += fresh
        return result

    def _expected(self, tr: dict) -> tuple[float, float]:
        if "motion" not in tr:  # worked out once per observation
            tr["motion"] = motion(tr["history"])
        x, y, dx, dy, step, span = tr["motion"]
        if not span:
            return x, y
        k = step * (min(tr["misses"], self.cfg.horizon - 1) + 1) / span
        return x + dx * k, y + dy * k


def segments(dets: DataFrame, max_age: int = 5) -> DataFrame:
    """Number the stretches of a survey between which every track has expired (more than ``max_age`` + 1 empty frames).

    Association never crosses such a gap, so stretches are independent and a long survey spreads over many tasks.
    """
    present = dets.select("survey_id", "frame_id").distinct()
    within = present.select("survey_id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(max_age + 1)), lambda k: F.col("frame_id") + k)).alias("frame_id"))
    starts = present.join(within.distinct().withColumn("_linked", F.lit(1)), ["survey_id", "frame_id"], "left")
    return running_sums(starts, ["survey_id"], ["frame_id"], {"segment": F.when(F.col("_linked").isNull(), 1).otherwise(0)}).select("survey_id", "frame_id", "segment")


def track(dets: DataFrame, cfg: TrackSettings = TrackSettings(), order: str = "det_id") -> DataFrame:
    """Assign track ids (unique per survey) to detections with x, y, class_name, in frame order.

    Each task walks its stretches frame by frame over sorted batches and keeps only the live tracks in memory.
    """
    tagged = dets.join(segments(dets, cfg.max_age), ["survey_id", "frame_id"])
    lean = tagged.select("survey_id", "segment", "frame_id", order, "x", "y", "class_name")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, tracker, held = None, None, None

        def run(pdf: pd.DataFrame, bounds: list[int]) -> pd.DataFrame:
            nonlocal where, tracker
            survey, stretch, frame = (pdf[c].to_numpy() for c in ("survey_id", "segment", "frame_id"))
            xs, ys, names = pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["class_name"].to_numpy()
            marks: list[tuple[int, int]] = []
            for a, b in zip(bounds[:-1], bounds[1:]):
                if (survey[a], stretch[a]) != where:
                    where, tracker = (survey[a], stretch[a]), FrameTracker(cfg)
                marks += tracker.update(int(frame[a]), xs[a:b], ys[a:b], names[a:b])
            done = pdf.iloc[: bounds[-1]]
            return pd.DataFrame({"survey_id": done["survey_id"], "segment": done["segment"], order: done[order],
                                 "local_id": [i for i, _ in marks], "hits": [h for _, h in marks]})

        for pdf in batches:
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            keys = [pdf[c].to_numpy() for c in ("survey_id", "segment", "frame_id")]
            cuts = [0, *(np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1).tolist()]
            held = pdf.iloc[cuts[-1]:]  # the last frame may go on in the next batch
            if len(cuts) > 1:
                yield run(pdf, cuts)
        if held is not None and len(held):
            yield run(held, [0, len(held)])

    types = {f.name: f.dataType.simpleString() for f in lean.schema.fields}
    schema = f"survey_id {types['survey_id']}, segment bigint, {order} {types[order]}, local_id bigint, hits bigint"
    # a fixed number of partitions: walking is compute-bound, so small inputs must not be folded into one task
    width = int(dets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    walked = (lean.withColumn("segment", F.col("segment").cast("bigint")).repartition(width, "survey_id", "segment")
              .sortWithinPartitions("survey_id", "segment", "frame_id", order).mapInPandas(walk, schema))
    walked = durable(walked, "tracks")  # read twice below
    # ids of later stretches continue after those of earlier ones
    sizes = walked.groupBy("survey_id", "segment").agg(F.max("local_id").alias("_n"))
    offsets = running_sums(sizes, ["survey_id"], ["segment"], {"_upto": "_n"}).select("survey_id", "segment", (F.col("_upto") - F.col("_n")).alias("_before"))
    ids = walked.join(offsets, ["survey_id", "segment"]).select("survey_id", order, (F.col("local_id") + F.col("_before")).alias("track_id"), "hits")
    return dets.drop("track_id", "hits").join(ids, ["survey_id", order])


# ---- histories ------------------------------------------------------------------------------------------------------------

def number_observations(obs: DataFrame, order: Sequence[str] = ("t",), keys: Sequence[str] = TRACK) -> DataFrame:
    return dense_index(obs, list(keys), list(order), "obs_no")


def _recent(obs: DataFrame, n: int, keys: Sequence[str] = TRACK, chunk: int = CHUNK) -> DataFrame:
    """Add ``recent``: the observation and up to n - 1 before it, oldest first."""
    w = Window.partitionBy(*keys, "_chunk").orderBy("obs_no").rowsBetween(-(n - 1), 0)
    seen = with_chunks(obs, "obs_no", chunk, before=n - 1).withColumn("recent", F.collect_list(F.struct("t", "x", "y", "w", "h", "conf")).over(w))
    return seen.filter("_own").drop("_chunk", "_own")


def track_features(obs: DataFrame, n: int = 8, keys: Sequence[str] = TRACK) -> DataFrame:
    """Motion features of the last n observations at every observation: array of n arrays of nine numbers.

    Offsets to the latest position, size, confidence, time step, velocity and heading / pi; short histories repeat
    their first observation on the left.
    """
    rec = _recent(obs, n, keys)
    padded = F.concat(F.array_repeat(F.get("recent", F.lit(0)), F.lit(n) - F.size("recent")), F.col("recent"))
    staged = rec.withColumn("_p", padded).withColumn("_last", F.element_at("_p", -1))
    staged = staged.withColumn("_q", F.concat(F.slice("_p", 1, 1), F.slice("_p", 1, n - 1)))

    def one(o: Column, prev: Column) -> Column:
        dt = F.greatest(o["t"] - prev["t"], F.lit(0.0))
        vx = F.when(dt > 0, (o["x"] - prev["x"]) / dt).otherwise(F.lit(0.0))
        vy = F.when(dt > 0, (o["y"] - prev["y"]) / dt).otherwise(F.lit(0.0))
        heading = F.when((vx != 0) | (vy != 0), F.atan2(vy, vx) / np.pi).otherwise(F.lit(0.0))
        return F.array((o["x"] - F.col("_last.x")) / POS_SCALE, (o["y"] - F.col("_last.y")) / POS_SCALE, o["w"] / SIZE_SCALE, o["h"] / SIZE_SCALE,
                       o["conf"].cast("double"), dt, vx / POS_SCALE, vy / POS_SCALE, heading)

    return staged.withColumn("features", F.zip_with("_p", "_q", one)).drop("_p", "_q", "_last", "recent")


def cv_forecast(obs: DataFrame, horizon: int = 5, window: int = 3, keys: Sequence[str] = TRACK) -> DataFrame:
    """Constant-velocity positions 1..horizon steps ahead of every observation, one row per step."""
    rec = _recent(obs, window + 1, keys)
    first, last = F.get("recent", F.lit(0)), F.element_at("recent", -1)
    rec = rec.withColumns({
        "_span": last["t"] - first["t"], "_dx": last["x"] - first["x"], "_dy": last["y"] - first["y"],
        "_step": F.when(F.size("recent") >= 2, last["t"] - F.get("recent", F.size("recent") - 2)["t"])})
    rec = rec.withColumn("_step", F.when(F.col("_step") == 0, 1.0).otherwise(F.col("_step")))
    moving = (F.size("recent") >= 2) & (F.col("_span") > 0)
    out = rec.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    ahead = lambda p, d: F.col(p) + F.when(moving, F.col(d) / F.col("_span") * F.col("_step") * F.col("step")).otherwise(F.lit(0.0))
    return out.select(*keys, "obs_no", "t", "step", ahead("x", "_dx").alias("px"), ahead("y", "_dy").alias("py"))


def track_snapshot(obs: DataFrame, min_hits: int = 3, keys: Sequence[str] = TRACK) -> DataFrame:
    """Latest position, velocity of the last step, hits and state per track: one combining aggregate, no window."""
    rec = F.struct("obs_no", "t", "x", "y", "w", "h", "conf")
    two = obs.groupBy(*keys).agg(F.max(rec).alias("_l"), F.count(F.lit(1)).alias("hits"))
    prev = obs.join(two.select(*keys, (F.col("_l.obs_no") - 1).alias("obs_no")), [*keys, "obs_no"], "left_semi").select(
        *keys, F.col("t").alias("_t"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    j = two.join(prev, list(keys), "left")
    dt = F.when(F.col("_l.t") - F.col("_t") == 0, 1.0).otherwise(F.col("_l.t") - F.col("_t"))
    v = lambda c: F.coalesce((F.col(f"_l.{c}") - F.col(f"_{c}")) / dt, F.lit(0.0))
    return j.select(*keys, F.col("_l.x").alias("x"), F.col("_l.y").alias("y"), F.col("_l.w").alias("w"), F.col("_l.h").alias("h"), F.col("_l.conf").alias("confidence"),
                    v("x").alias("vx"), v("y").alias("vy"), "hits", F.when(F.col("hits") >= min_hits, "confirmed").otherwise("tentative").alias("state"))


def track_switches(assigned: DataFrame, keys: Sequence[str] = (), chunk: int = CHUNK) -> DataFrame:
    """Identity switches, share of the main track and number of further tracks per true object (keys, gt_id)."""
    obj = [*keys, "gt_id"]
    real = dense_index(assigned.filter("gt_id >= 0 and track_id is not null"), obj, ["frame_id", "det_id"], "_i")
    w = Window.partitionBy(*obj, "_chunk").orderBy("_i")
    steps = with_chunks(real, "_i", chunk, before=1).withColumn("_p", F.lag("track_id").over(w)).filter("_own")
    per = steps.groupBy(*obj).agg(F.count_if(F.col("_p") != F.col("track_id")).alias("switches"))
    votes = real.groupBy(*obj, "track_id").agg(F.count(F.lit(1)).alias("n")).groupBy(*obj).agg(
        (F.max("n") / F.sum("n")).alias("dom"), (F.count(F.lit(1)) - 1).alias("frag"))
    return per.join(votes, obj)


def tracking_metrics(assigned: DataFrame, min_hits: int = 3, chunk: int = CHUNK, keys: Sequence[str] = ()) -> DataFrame:
    """ID switches, continuity, fragmentations, success and false tracks from (keys, gt_id, frame_id, track_id, det_id).

    ``keys`` (say the survey) separate scopes in which ids are numbered anew. ``gt_id`` -1 marks a detection without a
    true object. A track that two objects share equally belongs to the one it met first.
    """
    g = track_switches(assigned, keys, chunk).agg(
        F.count(F.lit(1)).alias("n_gt_tracks"), F.sum("switches").alias("id_switches"), F.avg("dom").alias("track_continuity"),
        F.sum("frag").alias("fragmentations"), F.avg(((F.col("dom") >= 0.8) & (F.col("switches") == 0)).cast("int")).alias("success_rate"))
    t = assigned.filter("track_id is not null").groupBy(*keys, "track_id", "gt_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("frame_id", "det_id")).alias("met"))
    t = t.groupBy(*keys, "track_id").agg(F.sum("n").alias("hits"), F.min(F.struct((-F.col("n")).alias("n"), F.col("met"), F.col("gt_id").alias("g"))).alias("_b")).filter(F.col("hits") >= min_hits)
    f = t.agg(F.count(F.lit(1)).alias("total_tracks"), F.avg((F.col("_b.g") == -1).cast("int")).alias("false_track_rate"))
    return with_totals(g, f)


def forecast_errors(pred: DataFrame, truth: DataFrame, keys: Sequence[str]) -> DataFrame:
    """MAE / RMSE of the first step and over the horizon, mean and final displacement error. ``step`` counts from 1."""
    j = pred.join(truth, [*keys, "step"])
    dx, dy = F.col("px") - F.col("tx"), F.col("py") - F.col("ty")
    first, last = F.col("step") == 1, F.col("step") == F.col("_h")
    j = with_totals(j, pred.agg(F.max("step").alias("_h")))
    mae = (F.abs(dx) + F.abs(dy)) / 2
    mse = (dx * dx + dy * dy) / 2
    dist = F.sqrt(dx * dx + dy * dy)
    return j.agg(F.avg(F.when(first, mae)).alias("mae_step1"), F.sqrt(F.avg(F.when(first, mse))).alias("rmse_step1"), F.avg(mae).alias("mae_horizon"),
                 F.sqrt(F.avg(mse)).alias("rmse_horizon"), F.avg(dist).alias("ade"), F.avg(F.when(last, dist)).alias("fde"))


def training_windows(obs: DataFrame, truth: DataFrame, horizon: int = 5, keys: Sequence[str] = TRACK) -> DataFrame:
    """Future displacement of each observation (from the third on) at +1..+horizon frames, only where all are known.

    ``truth``: keys, frame, tx, ty. Output: one row per observation with the displacement arrays.
    """
    base = obs.filter("obs_no >= 2").select(*keys, "obs_no", "x", "y", F.bround("t").cast("bigint").alias("_f"))
    ask = base.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("frame", F.col("_f") + F.col("step"))
    got = ask.join(truth, [*keys, "frame"])
    out = got.groupBy(*keys, "obs_no").agg(
        F.count(F.lit(1)).alias("_n"), F.sort_array(F.collect_list(F.struct("step", (F.col("tx") - F.col("x")).alias("dx"), (F.col("ty") - F.col("y")).alias("dy")))).alias("_d"))
    return out.filter(F.col("_n") == horizon).select(*keys, "obs_no", F.transform("_d", lambda s: s["dx"]).alias("dx"), F.transform("_d", lambda s: s["dy"]).alias("dy"))


def overfit_check(log: DataFrame, keys: Sequence[str] = ("run_id",), share: float = 0.25, min_epochs: int = 3) -> DataFrame:
    """Slope of validation and training box loss over the last quarter of the epochs; rising against falling = overfit."""
    numbered = dense_index(log, list(keys), ["epoch"], "_i")
    n = log.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    tail_len = F.greatest(F.lit(min_epochs), F.floor(F.col("_n") * share))
    tail = numbered.join(n, list(keys)).filter(F.col("_i") >= F.col("_n") - tail_len)
    s = tail.groupBy(*keys).agg(F.regr_slope("val_box_loss", "_i").alias("val_slope"), F.regr_slope("train_box_loss", "_i").alias("train_slope"))
    return s.withColumn("overfit", (F.col("val_slope") > 0.005) & (F.col("train_slope") < -0.002))
