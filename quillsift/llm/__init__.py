"""Operators for preparing training data at scale.

Nothing outside this subpackage imports it, so it can be removed as a whole
(with ``tests/llm`` and ``corpus_pipeline.py``) without touching the rest.
"""
