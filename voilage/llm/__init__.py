"""Operators for preparing training text: duplicates, quality, language, packing, tokens, licences, vectors.

Nothing else in the library imports this subpackage.
"""
