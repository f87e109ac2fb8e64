"""Operators for large-scale training data. Optional: nothing outside this folder imports it."""
