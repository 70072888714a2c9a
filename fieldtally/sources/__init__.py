"""Readers, schemas and writers for trip and order data."""
