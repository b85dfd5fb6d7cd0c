"""Plan-level helpers: lineage cuts and sizes."""
