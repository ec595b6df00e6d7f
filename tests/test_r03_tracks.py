"""Third review: a survey's waiting frames are held in parts."""
import random

import pandas as pd

from sonarlake.config import TrackSettings
from sonarlake.operators.tracking import FrameTracker
from sonarlake.streaming import tracks as ts


class Value:
    def __init__(self, seen):
        self.v, self.seen = None, seen

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.seen.append(max((len(x) for x in v if isinstance(x, list)), default=0))
        self.v = v

    def clear(self):
        self.v = None


class Map(Value):
    def __init__(self, seen):
        super().__init__(seen)
        self.m = {}

    def getValue(self, k):
        return self.m[k]

    def updateValue(self, k, v):
        self.update(v)
        self.m[k] = v

    def removeKey(self, k):
        del self.m[k]


class Handle:
    def __init__(self):
        self.seen, self.timers, self.now, self.states = [], [], 0, []

    def getValueState(self, *_):
        self.states.append(Value(self.seen))
        return self.states[-1]

    def getMapState(self, *_):
        self.states.append(Map(self.seen))
        return self.states[-1]

    def registerTimer(self, at):
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):
        return self.now


def test_a_long_survey_is_held_and_walked_in_parts(monkeypatch):
    rng = random.Random(5)
    rows = pd.DataFrame([(f, 6 * f + k, 1000 + f, rng.random() * 300, rng.random() * 300, "can") for f in range(3000) for k in range(rng.randrange(1, 5))], columns=ts.HELD)
    want, tracker = {}, FrameTracker(TrackSettings())
    for f, g in rows.groupby("frame_id"):
        want.update(zip(g["det_id"], tracker.update(int(f), g["x"].to_numpy(), g["y"].to_numpy(), g["class_name"].tolist())))
    monkeypatch.setattr(ts, "PUT_ROWS", 2000, raising=False)
    handle, walker, got = Handle(), ts.HeldFrames(TrackSettings()), []
    walker.init(handle)
    mixed = rows.sample(frac=1, random_state=1)
    early, late = mixed[mixed["frame_id"] < 2000], mixed[mixed["frame_id"] >= 1990]
    early = early[early["frame_id"] < 1990]
    for part, now in ((early, 1700), (late.iloc[:800], 1700), (late.iloc[800:], 10_000)):
        list(walker.handleInputRows((1,), iter([part.iloc[k:k + 500] for k in range(0, len(part), 500)]), handle))
        assert min(handle.timers) <= 1000 + 3000
        handle.now = now
        got += list(walker.handleExpiredTimer((1,), handle, None))
        assert {f for pdf in got for f in pdf["frame_id"]} == set(range(701 if now == 1700 else 3000))
    out = pd.concat(got)
    assert {d: (t, h) for d, t, h in zip(out["det_id"], out["track_id"], out["hits"])} == want and len(out) == len(rows)
    assert max(handle.seen) <= 4 * 128
    assert not handle.states[0].m and not handle.states[1].exists()
