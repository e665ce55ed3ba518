"""Readers, writers and publication gates."""
