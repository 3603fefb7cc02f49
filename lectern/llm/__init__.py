"""Operators of a training-data pipeline, as Spark jobs.

Nothing else in the library imports this subpackage.
"""
