"""Spark operators for price comparison, price tracking and page extraction."""
