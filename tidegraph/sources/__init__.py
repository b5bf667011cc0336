"""Loaders of operation logs and graph tables, and sinks."""
