"""Readers with explicit schemas, and writers for every hand-off file."""
