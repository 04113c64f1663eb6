"""Operators for large-scale training-data pipelines.

Each module holds one operator with a general interface; ``registry`` derives the contract queries from them.
Nothing outside this subpackage imports it.
"""
