"""Operators for preparing language-model training corpora at scale.

Nothing outside this subpackage imports it; ``queries`` registers its queries.
"""
