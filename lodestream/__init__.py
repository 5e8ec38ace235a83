"""Spark-first analytics over crawl indexes, pages and domains."""
