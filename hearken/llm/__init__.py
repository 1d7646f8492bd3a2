"""Operators for building training data: record matching, list mapping, hidden duplicates, encoding, leaks and abuse."""
