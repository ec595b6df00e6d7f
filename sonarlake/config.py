"""Survey settings. Plain nested dataclasses on the driver; ``config_hash`` stamps results."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from dataclasses import dataclass, field

# Default limits, weights and sizes that results must agree on.


@dataclass(frozen=True)
class QualityLimits:
    max_zero_ratio: float = 0.60
    max_saturation_ratio: float = 0.25
    min_dynamic_range_db: float = 6.0
    min_altitude_m: float = 2.0
    max_altitude_m: float = 40.0
    max_pitch_roll_deg: float = 12.0


@dataclass(frozen=True)
class CfarSettings:
    guard_size: int = 4
    ref_size: int = 14
    scaling: float = 1.65
    min_target_area: int = 15
    max_target_area: int = 10000
    merge_gap_px: int = 20
    candidate_pad_px: int = 8


@dataclass(frozen=True)
class FusionSettings:
    w_cfar: float = 0.25
    w_yolo: float = 0.40
    w_anomaly: float = 0.25
    w_snr: float = 0.10
    w_shadow: float = 0.20
    known_min_conf: float = 0.35
    unknown_min_anomaly: float = 0.50
    noise_max_fused: float = 0.45
    min_tile_snr_db: float = 3.0
    max_tile_snr_db: float = 20.0


@dataclass(frozen=True)
class TrackSettings:
    seq_len: int = 8
    horizon: int = 5
    max_age: int = 5
    match_dist_px: float = 60.0
    class_penalty: float = 15.0
    min_hits: int = 3


@dataclass(frozen=True)
class GisSettings:
    kde_grid: int = 60
    kde_bandwidth_deg: float = 0.0005
    hotspot_percentile: float = 90.0
    scqi_cell_deg: float = 0.0004
    resurvey_threshold: float = 55.0


@dataclass(frozen=True)
class SurveyConfig:
    frame_height: int = 384
    frame_stride: int = 192
    frame_min: int = 64
    tile_size: int = 64
    quality: QualityLimits = field(default_factory=QualityLimits)
    cfar: CfarSettings = field(default_factory=CfarSettings)
    fusion: FusionSettings = field(default_factory=FusionSettings)
    track: TrackSettings = field(default_factory=TrackSettings)
    gis: GisSettings = field(default_factory=GisSettings)

    def override(self, **dotted: object) -> "SurveyConfig":
        """``override(**{"cfar.merge_gap_px": 6})``; unknown names raise."""
        out = self
        for name, value in dotted.items():
            section, _, leaf = name.rpartition(".")
            if section:
                part = dataclasses.replace(getattr(out, section), **{leaf: value})
                out = dataclasses.replace(out, **{section: part})
            else:
                out = dataclasses.replace(out, **{leaf: value})
        return out

    @property
    def hash(self) -> str:
        return config_hash(dataclasses.asdict(self))


def config_hash(settings: dict) -> str:
    """First 12 hex digits of the SHA-256 of the sorted JSON form."""
    text = json.dumps(settings, sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:12]
