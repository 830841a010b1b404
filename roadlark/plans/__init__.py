"""Queries over the synthetic tables, each with its SQL twin where SQL expresses it."""
