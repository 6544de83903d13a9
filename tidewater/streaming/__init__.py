"""Finishers that run beside the caller."""
