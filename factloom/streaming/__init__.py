"""Incremental learning on streams."""
