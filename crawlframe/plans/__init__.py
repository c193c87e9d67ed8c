"""Whole jobs: the hunt over fetched pages, the reports, and the query catalogue."""
