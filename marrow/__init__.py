"""Hybrid text retrieval and corpus processing as Spark plans."""
