"""Readers and writers for the text formats the engine meets."""
