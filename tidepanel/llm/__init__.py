"""Operators for large training-data pipelines.

Nothing else in the package imports this subpackage; it can be removed as a
whole together with ``corpus_pipeline.py`` and ``tests/llm``.
"""
