"""Readers that turn landed files into the engine's relations."""
