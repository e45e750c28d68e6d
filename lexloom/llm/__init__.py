"""Operators for large training-data pipelines.

Nothing else in the library imports this subpackage; the repository entry
adds its queries only when the folder is present.
"""
