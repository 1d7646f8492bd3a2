"""Relational, sequence and ranking operators."""
