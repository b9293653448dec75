"""Readers and table maintenance."""
