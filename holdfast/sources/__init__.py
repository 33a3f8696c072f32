"""Readers of manifests and of file trees."""
