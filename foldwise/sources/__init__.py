"""Readers, writers and the keyed prediction store."""
