"""Readers, writers and catalogues, and the mapping of the sample tables."""
