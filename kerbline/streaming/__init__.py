"""Structured Streaming forms of the weekly chain."""
