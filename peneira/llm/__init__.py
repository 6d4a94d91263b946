"""Operators for preparing large text corpora for training.

Nothing else in the library imports this subpackage. Each module holds one
operator with its own general interface; ``queries`` binds the operators to the
tables under the names ``opN_<name>``.
"""
