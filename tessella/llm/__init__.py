"""Operators for preparing training corpora.

One module per operator, one ``queries`` module that registers them.  Nothing
outside this subpackage imports it.
"""
