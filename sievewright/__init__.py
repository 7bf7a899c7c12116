"""Spark-first engine for discovering, cleaning, structuring and ranking job postings."""
