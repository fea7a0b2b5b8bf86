"""Matching by nearest time; the operator is the core's."""

from wayfold.operators.nearest import nearest_in_time

__all__ = ["nearest_in_time"]
