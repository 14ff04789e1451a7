"""Sequence-affinity analytics as Spark dataflows."""
