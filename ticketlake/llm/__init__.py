"""Operators for training-data preparation, with their registered queries.

Nothing outside this package imports it; ``__spark_entry__`` adds ``queries.queries()``
and ``queries.oracle_sql()`` when the package can be imported.
"""
