"""Operators for training data: one module for each numbered problem.

Nothing outside this subpackage imports it; ``queries`` and ``oracle_sql`` of
:mod:`weftline.llm.registry` are picked up by ``__spark_entry__`` when the
subpackage is present.
"""
