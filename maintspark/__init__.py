"""Spark jobs for fleet-maintenance data."""
