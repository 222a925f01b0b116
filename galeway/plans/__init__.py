"""Iteration to a fixed point, and views for SQL."""
