"""Readers, writers and incremental-maintenance jobs."""
