"""Ownership over a stream of scored pairs: each candidate's likeliest query so far.

State is one row per candidate, so it is bounded by the pool; no watermark is needed. The best of two rows does not depend
on their order, so a replayed batch changes nothing and the stream's last answer is the batch answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def owners(pairs: DataFrame, threshold: float) -> DataFrame:
    """candidate, query, prob of pairs (query, candidate, prob), streaming or not."""
    best = F.min_by(F.struct("query", "prob"), F.struct(-F.col("prob"), F.col("query")))
    kept = pairs.where(F.col("prob") >= threshold).groupBy("candidate").agg(best.alias("owner"))
    return kept.select("candidate", F.col("owner.query").alias("query"), F.col("owner.prob").alias("prob"))


def start(pairs: DataFrame, threshold: float, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the owners that each micro-batch changed to path/batch=N. Batches are replaced when they run again."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return owners(pairs, threshold).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def latest(written: DataFrame) -> DataFrame:
    """The last state of each candidate in what start() has written."""
    last = F.max_by(F.struct("query", "prob"), "batch")
    return written.groupBy("candidate").agg(last.alias("x")).select("candidate", "x.query", "x.prob")
