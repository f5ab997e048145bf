"""Readers, payload parsers, writers and the fixture relations."""
