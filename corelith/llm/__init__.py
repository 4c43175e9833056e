"""Operators for training-data pipelines over text tables.

Nothing outside this package imports it; see ``queries.py`` for the registered queries.
"""
