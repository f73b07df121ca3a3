"""Operators of a training-data pipeline over a documents table.

Nothing else in the library imports this subpackage. Every operator takes a
DataFrame and column names, selects the columns it needs first (so extra
columns with clashing names do no harm) and returns its own columns.
"""
