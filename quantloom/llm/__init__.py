"""Operators that turn raw corpora into training data, each a Spark job over whole tables.

Nothing outside this package imports it.
"""
