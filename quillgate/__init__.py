"""Outreach-data quality gates and experiment analytics as PySpark jobs."""
