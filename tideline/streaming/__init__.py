"""Streaming forms of counters over impressions (an extension; the batch operators do not need it)."""
