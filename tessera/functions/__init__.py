"""Functions that build Columns."""
