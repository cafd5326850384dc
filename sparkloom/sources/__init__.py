"""Readers, writers and interfaces to external tools."""
