"""Readers, adapters and keyed result tables."""
