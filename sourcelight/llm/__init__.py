"""Operators of a training-data pipeline.

Nothing else in the package imports this subpackage. Every operator takes and returns DataFrames; the modules
``op*`` hold one operator and its registered query each, :mod:`registry` lists the queries.
"""
