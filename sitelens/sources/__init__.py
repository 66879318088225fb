"""Readers and the checks on arriving rows."""
