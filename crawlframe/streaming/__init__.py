"""Structured Streaming forms of the crawl's running work."""
