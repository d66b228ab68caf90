"""Readers and writers of the planning data."""
