"""Operators for preparing language-model training data.

Each module holds one operator with a general interface, and the thin query
that applies it to the test tables.  ``queries.py`` lists the queries.
Nothing outside this subpackage imports it.
"""
