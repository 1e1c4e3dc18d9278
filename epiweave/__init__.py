"""Respiratory-surveillance analytics as Spark DataFrame operators."""
