"""Operators for building language-model training data.

Nothing outside this subpackage imports it; ``queries`` and ``oracle_sql``
live in :mod:`tidepanel.llm.registry`.
"""
