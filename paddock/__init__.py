"""Lap-timing and race-strategy analytics as Spark DataFrame jobs."""
