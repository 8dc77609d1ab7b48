"""Whole plans: several operators in a row."""
