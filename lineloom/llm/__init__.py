"""Operators for preparing language-model training data, and the queries that apply them.

Nothing outside this subpackage imports it; ``registry`` lists its queries.
"""
