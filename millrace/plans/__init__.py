"""Whole loads, and the operator queries with their SQL."""
