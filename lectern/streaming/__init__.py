"""Structured streams over the engine's tables."""
