"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage. Each module holds one
operator with its own general interface; ``queries.py`` registers one query
per operator and its DuckDB twin where SQL can express it.
"""
