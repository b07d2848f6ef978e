"""Alignment-free clustering of biological sequences on Spark."""
