"""Weights of graph edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How much a relation counts by how it came about.
KIND_WEIGHTS = {"extracted": 1.0, "co_occurrence": 0.8, "semantic_similarity": 0.5, "cross_chunk": 0.5, "bidirectional": 1.0, "predicted": 0.4}


def edge_weight(confidence: Column, kind: Column, canonical: Column, fitting: Column) -> Column:
    """Confidence by kind, 15 % up or down by whether the predicate is canonical, 10 % up or 20 % down by whether the types
    fit it, from .1 to 1. Null for either of the last two changes nothing."""
    by = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in KIND_WEIGHTS.items() for x in kv]), kind), F.lit(1.0))
    ontology = F.when(canonical, 1.15).when(~canonical, 0.85).otherwise(1.0)
    types = F.when(fitting, 1.1).when(~fitting, 0.8).otherwise(1.0)
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), confidence * by * ontology * types))
