"""Readers, writers and keyed stage tables."""
