"""Layered-lakehouse jobs, corpus audits and reconciliation as PySpark DataFrame code."""
