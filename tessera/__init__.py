"""Tessera: a Spark-first engine for document collections, property graphs and task streams."""
