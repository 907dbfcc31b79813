"""Readers for file trees, containers and binaries."""
