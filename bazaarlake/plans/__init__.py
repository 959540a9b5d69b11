"""Query registry and pipeline jobs."""
