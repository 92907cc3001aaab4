"""Operators for building training corpora: one module per operator, queries in ``queries``.

Nothing outside this subpackage imports it, so it can be removed whole.
"""
