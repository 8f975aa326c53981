"""Streaming extension of the engine."""
