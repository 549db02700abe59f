"""Operators of the training-data pipeline. Nothing outside this subpackage imports it."""
