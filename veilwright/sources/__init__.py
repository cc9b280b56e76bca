"""Readers, writers and the scratch store."""
