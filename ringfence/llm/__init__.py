"""Operators for large training-corpus pipelines.

Nothing else in the package imports this subpackage; its queries are added
by ``__spark_entry__`` when it can be imported.
"""
