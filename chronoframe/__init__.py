"""Relational operators on time intervals, planned and run by Spark."""
