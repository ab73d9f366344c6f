"""Readers, writers, code lists and resumable stages."""
