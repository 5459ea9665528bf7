"""Hybrid search over a table of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lexical import Bm25Tables, bm25_search
from ..operators.ranking import fail_open_filter, merge_rerank, pool_size, project_hits, result_count, rrf, shortlist
from ..operators.vectors import knn_items


def hybrid_search(queries: DataFrame, index: Bm25Tables, items: DataFrame, rows: DataFrame | None = None, plans: DataFrame | None = None, query_vectors: DataFrame | None = None,
                  rerank: DataFrame | None = None, max_results: int = 20, n_shortlist: int = 10) -> DataFrame:
    """Ranked hits of each query: both retrievers, fusion, filters that fail open, a model's order, names.

    ``plans`` holds ``query_id, semantic, plan``; ``rerank`` holds ``query_id, pos, i, why``; a step without its table is left out.
    """
    pool = pool_size(max_results, n_shortlist)
    asked = queries
    if plans is not None:
        asked = queries.join(plans.select("query_id", "semantic"), "query_id", "left").withColumn("text", F.coalesce("semantic", "text")).drop("semantic")
    lexical = bm25_search(asked, index, pool)
    empty = lexical.limit(0)
    vector = knn_items(query_vectors, rows, pool) if query_vectors is not None and rows is not None else empty
    fused = rrf(lexical, vector)
    if plans is not None:
        fused = fail_open_filter(fused, items, plans)
    if rerank is None:
        return project_hits(fused.where(F.col("rank") <= max_results), items)
    ranking, counts = merge_rerank(fused, rerank, n_shortlist)
    shown = ranking.join(counts.select("query_id", "ranked"), "query_id").where(F.col("rank") <= result_count(F.col("ranked"), max_results)).drop("ranked")
    return project_hits(shown, items)


def shortlists(fused: DataFrame, n: int) -> DataFrame:
    """``query_id, pos, item_id``: what a model is shown, counted from 0."""
    return shortlist(fused, n).select("query_id", (F.col("rank") - 1).alias("pos"), "item_id")
