"""Column expressions of graph analytics."""

from corelith.functions.counting import binomial, clique_upper_bound, h_value

__all__ = ["binomial", "clique_upper_bound", "h_value"]
