"""Operators over tidy tables of cells, edges, pairs and particles."""
