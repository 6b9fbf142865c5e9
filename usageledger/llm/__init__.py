"""Operators for preparing training data; see the README for the method of each.

Nothing else in the library imports this package.
"""
