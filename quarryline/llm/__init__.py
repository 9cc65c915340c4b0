"""Operators of a training-data pipeline; each module holds one operator and its query.

Nothing else in the library imports this subpackage.
"""
