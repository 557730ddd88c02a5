"""Operators for training-data pipelines over the tables documents, benchmark and pages.

Nothing else in the library imports this package; the registered queries are in ``queries``.
"""
