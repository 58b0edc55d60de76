"""Operators for preparing large text collections for training, and their named queries.

Nothing outside this subpackage imports it.
"""
