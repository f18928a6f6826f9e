"""leafmill: a PySpark engine that turns crawled sites, sitemaps and page texts into clean, searchable Markdown corpora."""
