"""Whole queries and their registration."""
