"""Incremental refresh.  The domain has no unbounded streams: new files are taken in batches."""
