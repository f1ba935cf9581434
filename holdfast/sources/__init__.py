"""Readers, writers and the subscriber table."""
