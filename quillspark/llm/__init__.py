"""Operators for building language-model training corpora.

Nothing outside this folder imports it.  ``registry`` holds the queries and
their SQL twins; every operator module has its own general interface.
"""
