"""Waymark: fleet GPS analytics as PySpark jobs."""
