"""Spark jobs over recorded build traces: path hygiene, identity, reports."""
