"""Operators for preparing large language-model training data.

Nothing outside this subpackage imports it.  Every module holds one operator;
``queries`` registers the thin query of each.
"""
