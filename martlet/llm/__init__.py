"""Operators for preparing language-model training data.

Each module holds one operator with its general interface; ``registry`` binds
them to the driver tables as ``opN_<name>`` queries.
"""
