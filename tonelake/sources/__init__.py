"""Readers, writers and tables that other modules start from."""
