"""Operators for large training-data pipelines: ten operators over `documents`-like tables.

Nothing else in the package imports this subpackage.
"""
