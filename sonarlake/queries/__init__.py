from .registry import ORACLES, QUERIES  # noqa: F401
from . import tables_check, pings_q, detections_q, waterfall_q, evaluation_q, streaming_q  # noqa: F401,E402
