"""Validity-aware retrieval and corpus analytics as Spark DataFrame jobs."""
