"""Operators over flow rows, counters and rollups."""
