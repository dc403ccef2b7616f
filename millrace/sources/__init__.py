"""Readers and extraction of fields from them."""
