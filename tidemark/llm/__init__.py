"""Operators for preparing training text at scale.

Nothing outside this package imports it.  Each module holds one operator;
``queries`` registers the queries that apply them to the corpus tables.
"""
