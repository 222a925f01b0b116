"""Constructors, readers and test fixtures."""
