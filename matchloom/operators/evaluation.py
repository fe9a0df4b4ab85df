"""Labels, blocking recall, macro F-beta and its sweep over thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.operators import ranking


def label_pairs(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """pairs with label 1 where (query, candidate) is in truth, else 0."""
    known = truth.select("query", "candidate").distinct().withColumn("hit", F.lit(1))
    return pairs.join(known, ["query", "candidate"], "left").withColumn("label", F.coalesce("hit", F.lit(0))).drop("hit")


def truth_counts(truth: DataFrame) -> DataFrame:
    """How many candidates each query truly has, those outside the pool included."""
    return truth.groupBy("query").agg(F.countDistinct("candidate").alias("n_true"))


def blocking_recall(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: found, total and found / max(total, 1)."""
    found = label_pairs(pairs.select("query", "candidate").distinct(), truth).agg(F.coalesce(F.sum("label"), F.lit(0)).alias("found"))
    total = truth.select("query", "candidate").distinct().agg(F.count("*").alias("total"))
    return found.crossJoin(total).withColumn("recall", F.round(F.col("found") / F.greatest("total", F.lit(1)), 6))  # one row by one row


def f_beta(tp: Column, predicted: Column, true: Column, beta: float) -> Column:
    """Of one query: both empty 1, one empty 0, nothing right 0."""
    p, r, b = tp / predicted, tp / true, beta * beta
    return F.when((predicted == 0) & (true == 0), 1.0).when((predicted == 0) | (true == 0) | (tp == 0), 0.0).otherwise((1 + b) * p * r / (b * p + r))


def macro_f_beta(queries: DataFrame, predicted: DataFrame, truth: DataFrame, beta: float = 0.5) -> DataFrame:
    """One row: the mean of f_beta over all queries."""
    p = predicted.select("query", "candidate").distinct()
    t = truth.select("query", "candidate").distinct()
    both = p.withColumn("p", F.lit(1)).join(t.withColumn("t", F.lit(1)), ["query", "candidate"], "full")
    counts = both.groupBy("query").agg(F.count("p").alias("np"), F.count("t").alias("nt"), F.sum(F.when(F.col("p").isNotNull() & F.col("t").isNotNull(), 1).otherwise(0)).alias("tp"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    scored = queries.select("query").join(counts, "query", "left").select(f_beta(zero(F.col("tp")), zero(F.col("np")), zero(F.col("nt")), beta).alias("f"))
    return scored.agg(F.round(F.avg("f"), 6).alias("macro_f"), F.count("*").alias("n_queries"))


def ownership_f_beta(queries: DataFrame, scored: DataFrame, truth: DataFrame, threshold: float, beta: float = 0.5) -> DataFrame:
    """macro_f_beta of what the queries own at the threshold: ownership is settled before anything is counted."""
    return macro_f_beta(queries, ranking.decide_ownership(scored, threshold), truth, beta)


def sweep(scored: DataFrame, true_counts: DataFrame, thresholds: list[float], beta: float = 0.5) -> DataFrame:
    """threshold, macro_f for each threshold. scored: query, prob, label; true_counts: query, n_true for every query.

    Instead of pairs times thresholds: each pair falls in the bucket of the highest threshold that it passes; buckets are
    counted per query (at most as many rows as thresholds), and running sums down the thresholds give what each one keeps.
    """
    spark = scored.sparkSession
    grid = spark.createDataFrame([(i, float(t)) for i, t in enumerate(thresholds)], "bucket int, threshold double")
    steps = F.array(*[F.lit(float(t)) for t in thresholds])
    bucket = F.size(F.filter(steps, lambda t: F.col("prob") >= t)) - 1
    counted = scored.withColumn("bucket", bucket).where("bucket >= 0").groupBy("query", "bucket").agg(F.count("*").alias("np"), F.sum("label").alias("tp"))
    # only a query's buckets change its F, so its F at other thresholds is that of its next bucket above
    down = Window.partitionBy("query").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, 0)
    runs = counted.select("query", "bucket", F.sum("np").over(down).alias("np"), F.sum("tp").over(down).alias("tp"))
    below = F.coalesce(F.lag("bucket").over(Window.partitionBy("query").orderBy("bucket")), F.lit(-1))
    runs = runs.withColumn("from", below + 1).join(true_counts, "query", "left")
    f = f_beta(F.col("tp"), F.col("np"), F.coalesce("n_true", F.lit(0)), beta)
    per_bucket = runs.withColumn("f", f).select(F.explode(F.sequence("from", "bucket")).alias("bucket"), "f").groupBy("bucket").agg(F.sum("f").alias("f"), F.count("*").alias("with_pairs"))
    # queries without a pair at a threshold score 1 if nothing is true of them
    tops = runs.groupBy("query").agg(F.max("bucket").alias("top"))
    empty = true_counts.join(tops, "query", "left").where("n_true = 0").select(F.explode(F.sequence(F.coalesce(F.col("top") + 1, F.lit(0)), F.lit(len(thresholds)))).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("right"))
    n = true_counts.agg(F.count("*").alias("n"))
    out = grid.join(per_bucket, "bucket", "left").join(empty, "bucket", "left").crossJoin(n)  # one row
    total = F.coalesce("f", F.lit(0.0)) + F.coalesce("right", F.lit(0))
    return out.select("threshold", F.round(total / F.greatest("n", F.lit(1)), 6).alias("macro_f"))


def best_threshold(swept: DataFrame) -> DataFrame:
    """The first threshold with the highest score."""
    return swept.orderBy(F.desc("macro_f"), F.asc("threshold")).limit(1)


def grid(start: float, stop: float, step: float, inclusive: bool = True) -> list[float]:
    """Thresholds rounded to 2 decimals."""
    n = round((stop - start) / step)
    return [round(start + i * step, 2) for i in range(n + 1 if inclusive else n)]
