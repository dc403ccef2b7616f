"""Relational operators: verdicts, history, validity, extraction, keyed writes."""
