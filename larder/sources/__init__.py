"""Readers, writers, schemas and constraints."""
