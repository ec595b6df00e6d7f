"""Score maps used by fusion and triage."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .boxes import clip


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once; a plain reference would be evaluated again inside every lambda."""
    return F.transform(F.array(value), body)[0]


def rounded(value: Column, digits: int) -> Column:
    """Half away from zero on the scaled value: a sum that lies a floating error below a tie counts as the tie, as in SQL engines."""
    scale = 10.0 ** digits
    return F.round(value * scale) / scale


def cfar_evidence(contrast: Column) -> Column:
    return clip((contrast - 1.0) / 3.0, 0.0, 1.0)


def snr_evidence(snr_db: Column, floor: float = 3.0, ceiling: float = 20.0) -> Column:
    return F.when(snr_db.isNotNull(), clip((snr_db - floor) / max(1e-6, ceiling - floor), 0.0, 1.0))


def weighted_mean(evidence: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """Weighted mean over the evidence that is present; weights of absent evidence are left out."""
    used = [(evidence[k], w) for k, w in weights.items() if w > 0 and k in evidence]
    num = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in used), F.lit(0.0))
    den = sum((F.when(c.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for c, w in used), F.lit(0.0))
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def temperature_scale(p: Column, temperature: float = 1.35) -> Column:
    q = clip(p, 1e-6, 1.0 - 1e-6)
    return 1.0 / (1.0 + F.exp(-(F.log(q / (1.0 - q)) / max(0.1, temperature))))


def error_to_score(error: Column, threshold: Column | float) -> Column:
    """Reconstruction error to [0, 1): 0.5 at the threshold, 0 for no error."""
    thr = F.lit(float(threshold)) if isinstance(threshold, (int, float)) else threshold
    return F.when((error > 0) & (thr > 0), 1.0 / (1.0 + F.pow(thr / error, F.lit(3.0)))).otherwise(F.lit(0.0))
