"""Spark-native retail analytics jobs: ingest, validate, enrich, window, score and report."""
