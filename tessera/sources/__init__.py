"""Readers, views of the data model, and connectors."""
