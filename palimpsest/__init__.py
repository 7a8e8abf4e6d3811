"""A Spark-first engine for knowledge that changes over time.

Concepts, corrections and typed links are bi-temporal tables; questions are answered by
DataFrame plans (exact, full-text, vector and fused retrieval, bounded traversal).  The
``llm`` subpackage adds training-data operators and is optional: nothing here imports it.
"""
