"""Readers of exports and landed records, and writers."""
