"""Bulk compliance analysis of online shops as Spark DataFrame jobs."""
