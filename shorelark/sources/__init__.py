"""Readers, normalisers and sinks."""
