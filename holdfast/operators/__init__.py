"""Relational operators over the catalogue's relations."""
