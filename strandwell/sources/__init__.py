"""Readers and writers of the engine's entity tables."""
