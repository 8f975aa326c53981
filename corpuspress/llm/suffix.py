"""Enhanced suffix arrays in numpy: the engine's own."""

from ..operators.suffixes import covered, lcp_intervals, maximal_repeats, neighbour_lcp, sort_suffixes

__all__ = ["covered", "lcp_intervals", "maximal_repeats", "neighbour_lcp", "sort_suffixes"]
