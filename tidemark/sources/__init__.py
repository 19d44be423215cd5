"""Readers and writers for examples, messages and run logs."""
