"""Operators of a training-data pipeline over ``documents``-shaped tables.

Nothing else in the library imports this subpackage; it may be removed whole.
"""
