"""Registered queries: operators applied to whole tables, with their SQL."""
