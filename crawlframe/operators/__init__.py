"""Operators over crawl tables: DataFrames in, DataFrames out."""
