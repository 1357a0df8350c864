"""Operators for preparing language-model training data.

Nothing outside this folder imports it.  ``queries`` registers the
production queries; every other module holds one operator.
"""
