"""Readers, the source registry and the incremental-read operators."""
