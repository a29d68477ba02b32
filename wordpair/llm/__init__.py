"""Operators of a training-data pipeline: one module per operator.

Nothing else in the package imports this subpackage; ``queries.py`` registers
the ``opN_*`` queries and their SQL.
"""
