"""Readers that produce ``series(series_id, ts, y)`` and writers for run results."""
