"""Operators for preparing language-model training data.

Every operator takes and returns DataFrames and has its own module; ``queries`` holds the
registered queries with their SQL. Nothing else in the library imports this subpackage.
"""
