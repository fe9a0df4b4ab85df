"""Candidate generation: lexical blocks capped by document frequency, and exact nearest neighbours."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions import similarity as S


def exploded(df: DataFrame, id_col: str, country: str, *arrays: Column) -> DataFrame:
    """(country, token, id): each distinct token of a record once."""
    words = F.array_distinct(F.array_union(*arrays) if len(arrays) > 1 else arrays[0])
    return df.select(F.col(country).alias("country"), F.explode(words).alias("token"), F.col(id_col).alias("id"))


def frequencies(tokens: DataFrame) -> DataFrame:
    """Document frequency of each (country, token); partial counts are taken before the shuffle."""
    return tokens.groupBy("country", "token").agg(F.count("*").alias("df"))


def capped(tokens: DataFrame, cap: int) -> DataFrame:
    """Rows whose (country, token) at most `cap` records have. A task sends at most cap + 1 rows of a token on (Catalyst limits
    each task's groups before the shuffle), so a token that all records have is a few rows per task where it is dropped."""
    key = Window.partitionBy("country", "token")
    few = tokens.withColumn("__n", F.row_number().over(key.orderBy("id"))).where(F.col("__n") <= cap + 1)
    return few.withColumn("__n", F.max("__n").over(key)).where(F.col("__n") <= cap).drop("__n")


def without_hot(queries: DataFrame, pool: DataFrame, cap: int, most: int = 100_000) -> DataFrame:
    """queries without tokens that surely find nothing: those that over `cap` pool records have, and over 1 in `most` of all
    its rows. There are under `most` such tokens whatever the pool's size, so they are broadcast."""
    counts = frequencies(pool)
    total = counts.agg(F.sum("df").alias("total"))  # one row
    hot = counts.crossJoin(F.broadcast(total)).where((F.col("df") > cap) & (F.col("df") * most > F.col("total"))).select("country", "token")
    return queries.join(F.broadcast(hot), ["country", "token"], "left_anti")


def block_pairs(queries: DataFrame, pool: DataFrame, cap: int) -> DataFrame:
    """(query, candidate, shared): pairs that share a token of their country which at most `cap` pool records have.

    queries and pool are (country, token, id). A token's pairs are at most cap times the queries that have it.
    """
    rare = capped(pool, cap).select("country", "token", F.col("id").alias("candidate"))
    pairs = without_hot(queries, pool, cap).select("country", "token", F.col("id").alias("query")).join(rare, ["country", "token"])
    return pairs.groupBy("query", "candidate").agg(F.count("*").alias("shared"))


def _lists(df: DataFrame, side: str, rows: int) -> DataFrame:
    """(country, token, __<side>_part, __<side>): rows of (country, token, ...) in lists of at most `rows`, numbered by all of
    the row, so that a task that runs again makes the same lists."""
    data = [c for c in df.columns if c not in ("country", "token")]
    place = F.row_number().over(Window.partitionBy("country", "token").orderBy(*data))
    dealt = df.withColumn(f"__{side}_part", F.floor((place - 1) / rows))
    return dealt.groupBy("country", "token", f"__{side}_part").agg(F.collect_list(F.struct(*data)).alias(f"__{side}"))


#: Rows of a list.
LIST = 2048


def meetings(queries: DataFrame, pool: DataFrame, rows: int = LIST) -> DataFrame:
    """Every pair of rows with equal country and token; queries and pool are (country, token, ...), their other columns' names
    differ.

    Lists of rows meet, are dealt out over all tasks, and become pairs only there: a token that most records have makes many
    meetings, none of more than rows^2 pairs, and what is shuffled is lists, not pairs.
    """
    met = _lists(queries, "q", rows).join(_lists(pool, "p", rows), ["country", "token"])
    spark = queries.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    met = met.repartition(tasks, "country", "token", "__q_part", "__p_part")
    # Generated code keeps all rows that come of one before it hands them on; the lambda keeps the outer list out of it.
    return met.select("__p", F.inline(F.transform("__q", lambda x: x))).select("*", F.inline("__p")).drop("__p")


def prefix_fallback(queries: DataFrame, pool: DataFrame, hit: DataFrame, cap: int, length: int = 5, fields: tuple[str, ...] = ()) -> DataFrame:
    """(query, candidate) by country and the name's first `length` characters (a shorter name: the whole) for queries (id,
    country, name) without any pair in `hit`; buckets of over 4 * cap pool records give none.

    Pairs are distinct. Those of buckets that may have more than a list of pool records aren't shuffled for it: each side's (id,
    token) are distinct, and two ids that both have several tokens are paired by the first that they share. With `fields`, columns
    of both sides, rows are instead the pairs of records, with these as left_* and right_*.
    """
    key = lambda df: df.select("country", F.substring("name", 1, length).alias("token"), "id", *fields)
    alone = queries.join(hit.select(F.col("query").alias("id")).distinct(), "id", "left_anti")
    bucket = key(pool)
    asked, bucket = (df.dropna(subset=["country", "token"]) for df in (without_hot(key(alone), bucket, 4 * cap), capped(bucket, 4 * cap)))
    if fields:
        named = lambda df, name, side: df.select("country", "token", F.col("id").alias(name), *(F.col(c).alias(f"{side}_{c}") for c in fields))
        return meetings(named(asked, "query", "left"), named(bucket, "candidate", "right"))
    if 4 * cap <= LIST:
        return asked.withColumnRenamed("id", "query").join(bucket.withColumnRenamed("id", "candidate"), ["country", "token"]).select("query", "candidate").distinct()

    def once(df: DataFrame, name: str) -> DataFrame:
        """Each id's tokens once, and all of them beside it if it has several."""
        d = df.groupBy("id").agg(F.collect_set(F.struct("country", "token")).alias("keys"))
        return d.select(F.inline("keys"), F.col("id").alias(name), F.when(F.size("keys") > 1, F.col("keys")).alias(f"{name}_keys"))

    q = once(asked, "query").withColumn("own", F.when(F.col("query_keys").isNotNull(), F.struct("country", "token")))
    both = F.col("query_keys").isNotNull() & F.col("candidate_keys").isNotNull()
    first = F.array_min(F.array_intersect("query_keys", "candidate_keys")) == F.col("own")
    return meetings(q, once(bucket, "candidate")).where(~both | first).select("query", "candidate")


def compatible(left: Column, right: Column) -> Column:
    """False only if both states are known and differ."""
    return ~((left != "") & (right != "") & (left != right))


def top_k(pairs: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k candidates of each query, with their rank from 1. Catalyst limits each partition's groups before the
    shuffle (WindowGroupLimit)."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy(*order))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def _best(sim: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k best; of equal ones those with the least order. Only what reaches the k-th value is sorted."""
    if sim.shape[1] > k:
        least = np.partition(sim, sim.shape[1] - k, axis=1)[:, sim.shape[1] - k]
        rows, columns = np.nonzero(sim >= least[:, None])
    else:
        rows, columns = (x.ravel() for x in np.indices(sim.shape))
    by = np.lexsort((order[columns], -sim[rows, columns], rows))
    rows, columns = rows[by], columns[by]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    keep = (place < k) & np.isfinite(sim[rows, columns])
    return rows[keep], columns[keep]


def nearest_blocked(queries: DataFrame, pool: DataFrame, k: int, partition: str | None = None, block_rows: int = 4096) -> DataFrame:
    """(query, candidate, sim, rank): exact top k by cosine, within a partition key if one is given. Both are (id, vector[,
    key]), with ids of any one type.

    Query blocks meet pool blocks: each meeting is one matrix product that keeps k candidates per query, and the blocks'
    candidates are merged by a window. Sides are counted first, and cut so that a block has about block_rows rows (and a pool
    block is ever larger, so that a query is sent to at most 64 of them).
    """
    country = F.col(partition).cast("string") if partition else F.lit("")
    cut = lambda df, rows: max(1, -(-df.count() // rows))
    pool_blocks = cut(pool, block_rows)
    pool_blocks = min(pool_blocks, 64 + pool_blocks // 16)
    query_blocks = cut(queries, block_rows)
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select("id", "vector", country.alias("country"), block(query_blocks).alias("qb")).withColumn("pb", every(pool_blocks))
    p = pool.select("id", "vector", country.alias("country"), block(pool_blocks).alias("pb")).withColumn("qb", every(query_blocks))
    keys = ["country", "qb", "pb"]

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query": left["id"].iloc[:0], "candidate": right["id"].iloc[:0], "sim": pd.Series([], dtype="float64")})
        a, b = (np.vstack([np.asarray(v, np.float64) for v in df["vector"]]) for df in (left, right))
        na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
        qi, ci = left["id"].to_numpy(), right["id"].to_numpy()
        names, order = np.unique(ci, return_inverse=True)
        own = np.minimum(np.searchsorted(names, qi), len(names) - 1)
        own = np.where(names[own] == qi, own, -1)
        out = []
        for i in range(0, len(qi), 512):  # so many rows of the product at a time
            size = na[i : i + 512, None] * nb[None, :]
            sim = np.divide(a[i : i + 512] @ b.T, size, out=np.zeros_like(size), where=size > 0).round(6)
            sim[own[i : i + 512, None] == order[None, :]] = -np.inf
            rows, columns = _best(sim, order, k)
            out.append(pd.DataFrame({"query": qi[rows + i], "candidate": ci[columns], "sim": sim[rows, columns]}))
        return pd.concat(out)

    kind = q.schema["id"].dataType.simpleString()
    found = q.groupBy(*keys).cogroup(p.groupBy(*keys)).applyInPandas(meet, f"query {kind}, candidate {kind}, sim double")
    return top_k(found, k, F.desc("sim"), F.asc("candidate"))


def cascade(pairs: DataFrame, k: int, *, legacy_scale: bool = False, weights: tuple[float, float, float] = (0.60, 0.20, 0.20)) -> DataFrame:
    """pairs: query, candidate, retrieval, jaccard, sort_ratio, position. The k best by the composite score; ties keep the
    order of retrieval."""
    score = S.cascade_score(F.col("retrieval"), F.col("jaccard"), F.col("sort_ratio"), weights, legacy_scale)
    return top_k(pairs.withColumn("score", F.round(score, 6)), k, F.desc("score"), F.asc("position"), F.asc("candidate"))
