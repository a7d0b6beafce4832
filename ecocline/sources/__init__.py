"""Readers, writers, schemas and lineage cuts."""
