"""Operators for large-scale text preparation. Nothing outside imports this package."""
