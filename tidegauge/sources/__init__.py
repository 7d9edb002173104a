"""Readers, caches and derived series."""
