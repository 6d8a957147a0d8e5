"""Spark-native crawl-data engine: frontier, pages, robots, sitemaps, storages and their statistics as DataFrames."""
