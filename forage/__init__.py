"""Dietary search and nutrition analytics as Spark DataFrame jobs."""
