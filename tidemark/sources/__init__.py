"""Readers, sinks and the bindings of market shapes to the sample tables."""
