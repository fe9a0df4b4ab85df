"""Training sets as queries: positives, triplets with negatives of the same country, seeded samples and holdouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.sources import tables


def mixed_order(id_col: str | Column, seed: int) -> Column:
    """A seeded pseudo-random number of 60 bits for an id of any type, the same in every engine."""
    told = F.concat(F.lit(f"{seed}:"), (F.col(id_col) if isinstance(id_col, str) else id_col).cast("string"))
    return F.conv(F.substring(F.md5(told), 1, 15), 16, 10).cast("long")


def sample(df: DataFrame, n: int, id_col: str, seed: int = 42) -> DataFrame:
    """n rows without replacement, by seeded order; ties by id."""
    return df.orderBy(mixed_order(id_col, seed), id_col).limit(n)


def sampled_pairs(pairs: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n of the pairs (query, candidate), by seeded order; all if there are no more."""
    order = mixed_order(F.concat_ws(":", F.col("query").cast("string"), F.col("candidate").cast("string")), seed)
    return pairs.orderBy(order, "query", "candidate").limit(n)


def first_pairs(pairs: DataFrame, n: int) -> DataFrame:
    """The first n pairs by query and candidate: a cap on a whole run, with its order stated."""
    return pairs.orderBy("query", "candidate").limit(n)


def filled_texts(df: DataFrame, text_col: str) -> DataFrame:
    """Rows whose text isn't blank: what an encoder without labels is trained on."""
    return df.where(F.trim(F.coalesce(F.col(text_col), F.lit(""))) != "")


def holdout(df: DataFrame, id_col: str, percent: int = 20, seed: int = 42) -> DataFrame:
    """df with split 'holdout' or 'train', by query id, so that all pairs of a query are on one side."""
    return df.withColumn("split", F.when(mixed_order(id_col, seed) % 100 < percent, "holdout").otherwise("train"))


def positives(truth: DataFrame, queries: DataFrame, pool: DataFrame) -> DataFrame:
    """(query, candidate) of truth whose both ends are known; distinct."""
    known = truth.join(queries.select(F.col("id").alias("query")), "query", "left_semi")
    return known.join(pool.select(F.col("id").alias("candidate")), "candidate", "left_semi").select("query", "candidate").distinct()


def text_pairs(pairs: DataFrame, queries: DataFrame, pool: DataFrame) -> DataFrame:
    """(query, candidate, left, right): pairs with the texts of both sides, (id, text); without those of which one is blank."""
    q, p = (filled_texts(d, "text").select("id", "text") for d in (queries, pool))
    return pairs.join(q.toDF("query", "left"), "query").join(p.toDF("candidate", "right"), "candidate").select("query", "candidate", "left", "right")


def triplets(pairs: DataFrame, pool: DataFrame, seed: int = 42, fallback: str | None = None) -> DataFrame:
    """(query, candidate, negative): a pool record of the candidate's country, another one than the candidate.

    The pool is numbered within its country by seeded order; a pair's place follows from its ids, and if that is the
    candidate itself the next one is taken. A candidate that is its country's only record gets its negative from the country
    `fallback`, if one is given, and else none. No task sees a whole country: the order is by range over all countries, and a
    place is a position less the country's first.
    """
    ordered = tables.numbered(pool.select("id", "country", mixed_order("id", seed).alias("mixed")), "country", "mixed", "id")
    spans = ordered.groupBy("country").agg(F.min("position").alias("first"), F.count("*").alias("size"))
    own = ordered.join(spans, "country").select(F.col("id").alias("candidate"), "country", (F.col("position") - F.col("first")).alias("own"), "first", "size")
    pick = mixed_order(F.concat_ws(":", F.col("query").cast("string"), F.col("candidate").cast("string")), seed)
    placed = pairs.select("query", "candidate").join(own, "candidate")
    alone = placed.where("size = 1")
    placed = placed.where("size > 1").withColumn("pick", pick % (F.col("size") - 1))
    chosen = placed.select("query", "candidate", (F.col("first") + F.col("pick") + F.when(F.col("pick") >= F.col("own"), 1).otherwise(0)).alias("position"))
    if fallback is not None:
        there = spans.where(F.col("country") == fallback).select(F.col("first").alias("f"), F.col("size").alias("s"))  # one row
        other = alone.where(F.col("country") != fallback).crossJoin(F.broadcast(there)).select("query", "candidate", (F.col("f") + pick % F.col("s")).alias("position"))
        chosen = chosen.unionByName(other)
    return chosen.join(ordered.select(F.col("id").alias("negative"), "position"), "position").select("query", "candidate", "negative")


def subset(queries: DataFrame, pool: DataFrame, truth: DataFrame, n: int, extra: int, skip: int = 0, skip_extra: int = 0) -> tuple[DataFrame, DataFrame]:
    """n queries by id after the first `skip`, and of the pool what they match besides `extra` records by id after the first
    `skip_extra`. With skips, the second half of a split that shares no query with the first."""
    first = queries.orderBy("id").offset(skip).limit(n)
    matched = truth.join(first.select(F.col("id").alias("query")), "query", "left_semi").select(F.col("candidate").alias("id"))
    wanted = matched.unionByName(pool.orderBy("id").offset(skip_extra).limit(extra).select("id")).distinct()
    return first, pool.join(wanted, "id", "left_semi")
