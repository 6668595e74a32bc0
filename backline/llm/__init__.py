"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage; it can be deleted with
``tests/llm`` and ``corpus_pipeline.py`` and the rest keeps working.
"""
