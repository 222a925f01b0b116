"""Scalar functions: geodesy and directions."""
