"""Readers of banks and notes, writers of events and backups, and adapters of the given tables."""
