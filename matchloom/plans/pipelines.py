"""Whole linkage runs: from records to owned matches. Each is a plan of DataFrame operators; nothing is collected but the
chosen threshold and the model's fit."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.functions import similarity as S
from matchloom.functions import text as T
from matchloom.operators import blocking, cache, evaluation, features, modeling, ranking, training
from matchloom.sources import scratch


@dataclass
class Settings:
    top_k: int = 150
    cap: int = 400
    grid: list[float] = field(default_factory=lambda: evaluation.grid(0.05, 0.95, 0.01))
    beta: float = 0.5
    holdout_percent: int = 20
    seed: int = 42
    iterations: int = 20
    folds: int = 3
    cascade_in: int = 50
    cascade_out: int = 15


@dataclass
class Result:
    candidates: DataFrame  # query, candidate, rank
    matches: DataFrame  # query, candidate, prob
    threshold: float
    holdout: DataFrame  # one row: macro_f, n_queries
    recall: DataFrame  # one row: found, total, recall


def lexical_candidates(queries: DataFrame, pool: DataFrame, s: Settings) -> DataFrame:
    """Token blocks, prefix fallback for queries without any, state filter, then the top k by the two fields' ratios.

    queries and pool are enriched records under id. The native state filter stands below the ratios' UDF.
    """
    keyed = lambda d: blocking.exploded(d, "id", "country_n", F.col("name_tokens"), F.col("addr_tokens"))
    hits = blocking.block_pairs(keyed(queries), keyed(pool), s.cap)
    named = lambda d: d.select("id", F.col("country_n").alias("country"), F.col("name_n").alias("name"))
    more = blocking.prefix_fallback(named(queries), named(pool), hits, s.cap)
    pairs = hits.select("query", "candidate").unionByName(more).distinct()
    side = lambda d, key, p: d.select(F.col("id").alias(key), *(F.col(c).alias(f"{p}_{c}") for c in ("name_n", "addr_n", "state")))
    pairs = pairs.join(side(queries, "query", "left"), "query").join(side(pool, "candidate", "right"), "candidate")
    pairs = pairs.where(blocking.compatible(F.col("left_state"), F.col("right_state")))
    score = 0.55 * S.ratio_column(F.col("left_name_n"), F.col("right_name_n")) + 0.45 * S.ratio_column(F.col("left_addr_n"), F.col("right_addr_n"))
    return blocking.top_k(pairs.select("query", "candidate", F.round(score, 6).alias("score")), s.top_k, F.desc("score"), F.desc("candidate"))


def dense_candidates(queries: DataFrame, pool: DataFrame, encoder: cache.Encoder, s: Settings) -> DataFrame:
    """Exact nearest neighbours within the country, of the records' canonical texts."""

    def vectors(d: DataFrame) -> DataFrame:
        text = T.entity_string(F.col("business_name"), F.col("business_address"), F.col("country"))
        return cache.encoded(d.withColumn("text", text), "id", "text", encoder).join(d.select("id", F.col("country_n").alias("country")), "id")

    return blocking.nearest_blocked(vectors(queries), vectors(pool), s.top_k, "country").withColumnRenamed("sim", "score")


def cascade_candidates(queries: DataFrame, pool: DataFrame, encoder: cache.Encoder, s: Settings, legacy_scale: bool = False) -> DataFrame:
    """Nearest neighbours whatever the country, then the best of each by the composite score on labelled texts."""
    none = F.lit("")
    text = T.labelled_text(F.col("business_name"), F.col("business_address"), none, none, F.col("country"))
    q, p = queries.select("id", text.alias("text")), pool.select("id", text.alias("text"))
    near = blocking.nearest_blocked(cache.encoded(q, "id", "text", encoder), cache.encoded(p, "id", "text", encoder), s.cascade_in)
    pairs = near.join(q.toDF("query", "a"), "query").join(p.toDF("candidate", "b"), "candidate")
    pairs = pairs.select("query", "candidate", F.col("sim").alias("retrieval"), F.col("rank").alias("position"), S.regex_jaccard(F.col("a"), F.col("b")).alias("jaccard"), (S.token_sort_column(F.col("a"), F.col("b")) / 100).alias("sort_ratio"))
    return blocking.cascade(pairs, s.cascade_out, legacy_scale=legacy_scale)


def rerank(candidates: DataFrame, queries: DataFrame, pool: DataFrame, truth: DataFrame, s: Settings) -> Result:
    """Two stages of boosted trees, calibration and the threshold, each on queries that the one before has not seen.

    A fifth of the queries is held out and only scored; the first stage's probabilities that the second trains on are out of
    fold; the calibration and the threshold use the training queries' out-of-fold scores.
    """
    fields = lambda d: d.select("id", F.col("name_n").alias("name"), F.col("addr_n").alias("address"), "pin", "house", "skeleton")
    rows = features.features_11(features.with_fields(candidates.select("query", "candidate"), fields(queries), fields(pool))).drop("stage1", "rank", "gap", "support")
    columns = [c for c in rows.columns if c not in ("query", "candidate")]
    rows = training.holdout(evaluation.label_pairs(rows, truth), "query", s.holdout_percent, s.seed)
    # written, as each of the models and the final scoring reads these rows
    spark = rows.sparkSession
    path = scratch.folder(spark, "features")
    rows = rows.withColumn("fold", (training.mixed_order("query", s.seed + 1) % s.folds).cast("int"))
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    train = rows.where("split = 'train'")
    options = {"iterations": s.iterations, "seed": s.seed}
    first = modeling.fit_reranker(train, columns, **options)
    staged = lambda d: features.with_context(d).withColumnRenamed("prob", "stage1")
    wide = [*columns, "stage1", "relative_rank", "best_gap", "support"]
    seen = staged(modeling.out_of_fold(train, columns, "fold", s.folds, **options))
    second = modeling.fit_reranker(seen, wide, **options)
    scored = second.transform(seen)
    curve = modeling.fit_calibration(scored)
    final = lambda d: modeling.calibrated(curve, d).drop("prob").withColumnRenamed("calibrated", "prob")
    counts = lambda d: d.select(F.col("id").alias("query")).join(evaluation.truth_counts(truth), "query", "left").select("query", F.coalesce("n_true", F.lit(0)).alias("n_true"))
    split = training.holdout(queries.select("id"), "id", s.holdout_percent, s.seed)
    swept = evaluation.sweep(final(scored).select("query", "prob", "label"), counts(split.where("split = 'train'")), s.grid, s.beta)
    threshold = float(evaluation.best_threshold(swept).first()["threshold"])
    everything = final(second.transform(staged(first.transform(rows))))
    matches = ranking.decide_ownership(everything, threshold)
    held = split.where("split = 'holdout'").select(F.col("id").alias("query"))
    score = evaluation.macro_f_beta(held, matches.join(held, "query", "left_semi"), truth.join(held, "query", "left_semi"), s.beta)
    return Result(candidates, matches, threshold, score, evaluation.blocking_recall(candidates, truth))
