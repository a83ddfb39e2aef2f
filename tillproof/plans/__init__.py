"""Whole jobs: the feed over the given tables, the shared workspace and the full run."""
