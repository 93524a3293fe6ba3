"""Keeping the stored tables: sealing, retention, purging, repair."""
