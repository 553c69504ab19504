"""Errors of the array operators."""


class DimensionMismatch(ValueError):
    """Arrays that must have the same axes don't."""
