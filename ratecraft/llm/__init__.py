"""Operators for preparing training corpora.

Nothing else in the library imports this subpackage; ``__spark_entry__`` adds
its queries when it is present.
"""
