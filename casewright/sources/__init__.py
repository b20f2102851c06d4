"""Where rows come from and how intermediate results are kept."""

from casewright.sources.tables import BROADCAST_ROWS, ensure_checkpoint_dir, materialise, release, scratch, small_side, spread_out, table

__all__ = ["BROADCAST_ROWS", "ensure_checkpoint_dir", "materialise", "release", "scratch", "small_side", "spread_out", "table"]
