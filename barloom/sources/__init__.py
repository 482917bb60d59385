"""Readers, normalising projections and sinks."""
