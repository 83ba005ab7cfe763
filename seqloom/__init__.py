"""Spark operators that turn user-item interaction logs into training data for sequential recommenders."""
