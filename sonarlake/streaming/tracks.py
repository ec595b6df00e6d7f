"""Tracking on a stream of detections, with unfinished frames held as keyed state.

A frame is walked when the watermark has passed the times of its detections and no lower frame of its survey is waiting, so
a frame may arrive in pieces, in several micro-batches and out of order. State per survey is the live tracks (a few short
histories) and the frames that the watermark has not passed yet. These are held by blocks of frames, a piece per arrival, and
walked block by block, so memory holds one block however long the survey is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sonarlake.config import TrackSettings
from sonarlake.operators.tracking import FrameTracker

#: Frames whose held rows are read together, and rows gathered before they are put into the state.
BLOCK_FRAMES, PUT_ROWS = 128, 1 << 18
HELD = ["frame_id", "det_id", "millis", "x", "y", "class_name"]
HELD_SCHEMA = "rows binary"  # a piece of a block as an Arrow stream: values are not taken through the state one by one
HELD_ARROW = pa.schema([(c, pa.float64() if c in "xy" else pa.string() if c == "class_name" else pa.int64()) for c in HELD])
LIVE_SCHEMA = ("ids array<bigint>, names array<string>, hits array<bigint>, misses array<bigint>, history array<double>, lengths array<bigint>, "
               "next_id bigint, frame bigint")
OUT_SCHEMA = "survey_id bigint, frame_id bigint, det_id bigint, track_id bigint, hits bigint"


def pack_tracker(tracker: FrameTracker) -> tuple:
    live = tracker.live
    return ([t["id"] for t in live], [t["name"] for t in live], [t["hits"] for t in live], [t["misses"] for t in live],
            [float(v) for t in live for seen in t["history"] for v in seen], [len(t["history"]) for t in live], tracker.next_id, tracker.frame)


def unpack_tracker(cfg: TrackSettings, state: tuple | None) -> FrameTracker:
    if state is None:
        return FrameTracker(cfg)
    ids, names, hits, misses, flat, lengths, next_id, frame = state
    live, at = [], 0
    for i, name, h, m, n in zip(ids, names, hits, misses, lengths):
        live.append({"id": i, "name": name, "hits": h, "misses": m, "history": [tuple(flat[k:k + 3]) for k in range(at, at + 3 * n, 3)]})
        at += 3 * n
    return FrameTracker(cfg, live, next_id, frame)


def packed(rows: pd.DataFrame) -> bytes:
    out = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_pandas(rows, HELD_ARROW, preserve_index=False)
    with pa.ipc.new_stream(out, HELD_ARROW, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def unpacked(piece: bytes) -> pd.DataFrame:
    with pa.ipc.open_stream(bytes(piece)) as reader:
        return reader.read_pandas()


class HeldFrames(StatefulProcessor):
    def __init__(self, cfg: TrackSettings):
        self.cfg = cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "block bigint, piece bigint", HELD_SCHEMA)
        self.index = handle.getValueState("index", "block array<bigint>, pieces array<bigint>")
        self.tracks = handle.getValueState("tracks", LIVE_SCHEMA)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        walked = self.tracks.get()[7] if self.tracks.exists() else None
        pieces, waiting, n = self._pieces(), [], 0
        for pdf in rows:
            new = pdf[HELD] if walked is None else pdf.loc[pdf["frame_id"] > walked, HELD]  # a frame at or below one already walked is late
            waiting, n = [*waiting, new], n + len(new)
            if n >= PUT_ROWS:
                self._put(pieces, pd.concat(waiting, ignore_index=True))
                waiting, n = [], 0
        if n:
            self._put(pieces, pd.concat(waiting, ignore_index=True))
        if pieces:
            self._remember(pieces)
            self._wake(self._load(min(pieces), pieces))
        return iter([])

    def _pieces(self) -> dict[int, int]:
        """Number of stored pieces per block of frames."""
        return dict(zip(*self.index.get())) if self.index.exists() else {}

    def _remember(self, pieces: dict[int, int]) -> None:
        if pieces:
            self.index.update((list(pieces), list(pieces.values())))
        else:
            self.index.clear()

    def _put(self, pieces: dict[int, int], rows: pd.DataFrame) -> None:
        for block, g in rows.groupby(rows["frame_id"] // BLOCK_FRAMES, sort=True):
            n = pieces.get(int(block), 0)
            self.held.updateValue((int(block), n), (packed(g),))
            pieces[int(block)] = n + 1

    def _load(self, block: int, pieces: dict[int, int]) -> pd.DataFrame:
        parts = [unpacked(self.held.getValue((block, k))[0]) for k in range(pieces[block])]
        return pd.concat(parts, ignore_index=True).sort_values(["frame_id", "det_id"])

    def _wake(self, rows: pd.DataFrame) -> None:
        """Wake up when the watermark passes the lowest of these frames."""
        self.handle.registerTimer(int(rows.loc[rows["frame_id"] == rows["frame_id"].iloc[0], "millis"].max()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, pieces, tracker = timerValues.getCurrentWatermarkInMs(), self._pieces(), None
        for block in sorted(pieces):
            rows = self._load(block, pieces)
            last = rows.groupby("frame_id")["millis"].max()
            open_ = np.flatnonzero(last.to_numpy() > now)
            ready = rows if not len(open_) else rows[rows["frame_id"] < last.index[open_[0]]]
            if len(ready):
                if tracker is None:
                    tracker = unpack_tracker(self.cfg, tuple(self.tracks.get()) if self.tracks.exists() else None)
                frame, xs, ys, names = (ready[c].to_numpy() for c in ("frame_id", "x", "y", "class_name"))
                cuts = [0, *(np.flatnonzero(frame[1:] != frame[:-1]) + 1).tolist(), len(ready)]
                marks = [m for a, b in zip(cuts[:-1], cuts[1:]) for m in tracker.update(int(frame[a]), xs[a:b], ys[a:b], names[a:b].tolist())]
                yield pd.DataFrame({"survey_id": key[0], "frame_id": frame, "det_id": ready["det_id"].to_numpy(), "track_id": [i for i, _ in marks], "hits": [h for _, h in marks]})
                for k in range(pieces.pop(block)):
                    self.held.removeKey((block, k))
                if len(open_):
                    self._put(pieces, rows.iloc[len(ready):])
            if len(open_):
                self._wake(rows.iloc[len(ready):])
                break
        if tracker is not None:
            self.tracks.update(pack_tracker(tracker))
            self._remember(pieces)

    def close(self) -> None:
        pass


def stream_track(dets: DataFrame, cfg: TrackSettings = TrackSettings(), delay: str = "10 minutes") -> DataFrame:
    """survey_id, frame_id, det_id, track_id, hits; ids and hits equal ``tracking.track`` on the frames the watermark has passed.

    ``dets`` carries survey_id, frame_id, det_id, ts (timestamp), x, y, class_name; rows without one of the first four take no
    part, and Spark takes times up to the epoch for late. Detections of a frame that was walked already give no row. Frames of a survey are walked one after the
    other by one task. The session must use the state store of ``trajectory.STORE``.
    """
    rows = dets.filter("survey_id IS NOT NULL AND frame_id IS NOT NULL AND det_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", delay)
    rows = rows.withColumn("millis", F.ceil(F.unix_micros("ts") / 1000.0).cast("bigint")).select("survey_id", "ts", *HELD)
    return rows.groupBy("survey_id").transformWithStateInPandas(HeldFrames(cfg), OUT_SCHEMA, "append", "EventTime")
