"""Operators that keep a state from plane to plane."""
