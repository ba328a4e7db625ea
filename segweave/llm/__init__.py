"""Operators for preparing language-model training data.

The subpackage is self-contained: nothing else in ``segweave`` imports it, and
it imports nothing from the rest of ``segweave``.
"""
