"""Operators for preparing training data: packing, search, filtering, mixing, scoring.

Nothing else in the library imports this subpackage.
"""
