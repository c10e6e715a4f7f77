"""Folioworks: document intelligence and retrieval analytics as Spark DataFrame jobs."""
