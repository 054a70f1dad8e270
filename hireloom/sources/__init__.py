"""Readers, writers and the derived relations."""
