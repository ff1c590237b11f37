"""Streaming forms of the tick operators."""
