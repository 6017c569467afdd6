"""Connected components, as the library computes them."""

from ..operators.graph import components

__all__ = ["components"]
