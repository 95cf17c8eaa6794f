"""Operators for preparing language-model training data.

Nothing else in ``quarry`` imports this subpackage; ``queries`` lists its registered queries.
"""
