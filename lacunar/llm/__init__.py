"""Operators for building training data from text, each usable on its own.

Nothing outside this package imports it.
"""
