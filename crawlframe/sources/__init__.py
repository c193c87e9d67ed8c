"""Reading crawl tables, deriving the standard views, and writing exports."""
