"""Operators for preparing language-model training text on Spark.

Nothing outside this subpackage imports it.
"""
