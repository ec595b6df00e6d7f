"""The derived tables themselves, compared with their SQL."""
from . import tables as t
from .registry import query

for _n, _f in [("fx_pings", t.pings), ("fx_cells", t.cells), ("fx_gt", t.gt), ("fx_pred", t.pred), ("fx_det", t.det),
               ("fx_frames", t.frames), ("fx_passes", t.passes), ("fx_scores", t.scores), ("fx_images", t.images),
               ("fx_labels", t.labels)]:
    query("table_" + _n[3:], _n, sql=f"select * from {_n}")(_f)
