"""Operators for preparing training corpora.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its own general interface; ``queries`` registers the thin
queries over the standard tables and ``sql`` their DuckDB equivalents.
"""
