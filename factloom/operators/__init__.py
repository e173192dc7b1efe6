"""Operators on tables of texts, chunks, evidence and vectors."""
