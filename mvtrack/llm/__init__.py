"""Operators that prepare text corpora for language-model training.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames; the ``op*`` queries built on them are in ``queries.py``.
"""
