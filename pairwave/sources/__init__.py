"""Readers, writers and generated catalogs."""
