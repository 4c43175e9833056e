"""Densest-subgraph queries over windows of an edge stream."""

from corelith.streaming.windows import densest_by_window, window_edges

__all__ = ["densest_by_window", "window_edges"]
