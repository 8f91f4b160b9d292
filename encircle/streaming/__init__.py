"""Run snapshots kept current while events arrive."""
