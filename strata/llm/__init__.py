"""Operators of a training-data pipeline: one module per operator, queries in ``queries.py``.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries when it is there.
"""
