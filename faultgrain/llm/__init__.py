"""Operators of a training-data pipeline, each a ``DataFrame -> DataFrame`` function."""
