"""Operators for preparing language-model training data, as Spark jobs.

Nothing else in the library imports this subpackage. ``queries()`` and
``oracle_sql()`` of :mod:`graphloom.llm.registry` hold its registered queries.
"""
