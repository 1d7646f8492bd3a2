"""Readers of exports, reference lists and the test tables."""
