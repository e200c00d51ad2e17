"""quillon: a Spark-first engine for text-corpus curation, quality gates and exact statistics.

Nothing in this package imports :mod:`quillon.llm`; that subpackage can be removed without
affecting the rest.
"""
