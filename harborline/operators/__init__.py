"""Operators over order lines, orders, scenarios and summaries."""
