"""Readers and writers of the domain's inputs and outputs."""
