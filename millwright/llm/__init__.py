"""Operators for training-data pipelines.

Nothing else in the library imports this subpackage; the library works
unchanged when the folder is removed.
"""
