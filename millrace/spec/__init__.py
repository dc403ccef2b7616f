"""The declarative specification: types, loading, inheritance, checks."""
