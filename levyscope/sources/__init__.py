"""Readers, literal tables and the feed sink."""
