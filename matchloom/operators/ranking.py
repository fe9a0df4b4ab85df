"""Ranks, gaps and context within each query's candidates, and the two kinds of decision."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rank_and_gaps(pairs: DataFrame, score: str = "sim") -> DataFrame:
    """Rank from 0, the best score, the distance to it, and the distance to the next (0 for the last)."""
    w = Window.partitionBy("query").orderBy(F.desc(score), F.asc("candidate"))
    return (
        pairs.withColumn("rank0", F.row_number().over(w) - 1)
        .withColumn("top1", F.first(score).over(w))
        .withColumn("gap_top", F.round(F.col("top1") - F.col(score), 6))
        .withColumn("gap_next", F.round(F.coalesce(F.col(score) - F.lead(score).over(w), F.lit(0.0)), 6))
    )


def context(pairs: DataFrame, prob: str = "prob") -> DataFrame:
    """Support (candidates of the query), relative rank, and the gap between the query's two best (0 if it has one)."""
    w = Window.partitionBy("query").orderBy(F.desc(prob), F.asc("candidate"))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    gap = F.first(prob).over(whole) - F.nth_value(prob, 2).over(whole)
    return (
        pairs.withColumn("support", F.count("*").over(Window.partitionBy("query")))
        .withColumn("relative_rank", F.round(F.row_number().over(w) / F.col("support"), 6))
        .withColumn("best_gap", F.round(F.coalesce(gap, F.lit(0.0)), 6))
    )


def decide_threshold(pairs: DataFrame, threshold: float, prob: str = "prob") -> DataFrame:
    """Pairs at or above the threshold, each for itself."""
    return pairs.where(F.col(prob) >= threshold)


def decide_ownership(pairs: DataFrame, threshold: float, prob: str = "prob") -> DataFrame:
    """At or above the threshold, and each candidate with its likeliest query only (ties: the smaller query).

    min_by takes partial results before the shuffle, so a candidate that many queries want is one row per task. Ids may be of
    any type that has an order.
    """
    best = F.min_by(F.struct("query", prob), F.struct(-F.col(prob), F.col("query")))
    kept = decide_threshold(pairs, threshold, prob).groupBy("candidate").agg(best.alias("owner"))
    return kept.select(F.col("owner.query").alias("query"), "candidate", F.col(f"owner.{prob}").alias(prob))


def listed(queries: DataFrame, pairs: DataFrame, order: list, name: str = "matched") -> DataFrame:
    """query, comma-joined candidates in order: every query has a row, '' if it has no candidate."""
    lists = pairs.groupBy("query").agg(F.sort_array(F.collect_list(F.struct(*order, F.col("candidate")))).alias("found"))
    ids = F.array_join(F.transform("found", lambda x: x["candidate"].cast("string")), ",")
    return queries.join(lists, "query", "left").select("query", F.coalesce(ids, F.lit("")).alias(name))
