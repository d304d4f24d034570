"""Operators of a training-data pipeline: one module per operator.

Nothing else in the library imports this subpackage.  ``queries`` and
``oracle`` register the operators; ``corpus_pipeline.py`` at the repository
top chains five of them.
"""
