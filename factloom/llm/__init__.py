"""Operators of a training-data pipeline: one module each, with their queries in ``registry``."""
