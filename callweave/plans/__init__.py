"""Composed chains of operators."""
