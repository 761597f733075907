"""Readers, writers and the adapters from the standard tables."""
