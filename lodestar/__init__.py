"""Spark-first analytics over crawled pages, documents and vectors."""
