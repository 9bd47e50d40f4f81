"""Readers and writers. Every dataset has an explicit schema; nothing is inferred from text files."""
from kgloom.sources.readers import table  # noqa: F401
