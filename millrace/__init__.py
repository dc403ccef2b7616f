"""Millrace: declarative loading, history and corpus building on Spark."""
