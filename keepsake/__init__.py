"""Archive fixity analytics on Spark: what was added, changed, lost or silently corrupted."""
