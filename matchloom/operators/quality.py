"""Checks of list-valued results, and profiles of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def issues(lists: DataFrame, required: DataFrame, valid: DataFrame | None = None, prefixes: tuple[str, ...] = ("S2-", "S3-"), own: str = "S1-") -> DataFrame:
    """(rule, n) of every rule that is broken at least once. lists: row, id, members (raw comma list); required: id;
    valid: id of known members, or None to skip that check.

    Rules: duplicate_row, repeated_member, self_match, bad_prefix (an empty member counts), unknown_member, missing_row,
    unexpected_row.
    """
    raw = F.coalesce(F.col("members"), F.lit(""))
    parts = F.when(F.trim(raw) == "", F.array().cast("array<string>")).otherwise(F.split(raw, ","))
    long = lists.select("row", "id", F.explode(parts).alias("member"))
    starts = F.lit(False)
    for p in (*prefixes, own):
        starts = starts | F.col("member").startswith(p)
    counts = [
        lists.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("n")).withColumn("rule", F.lit("duplicate_row")),
        long.groupBy("row", "member").agg(F.count("*").alias("n")).where("n > 1").select("row").distinct().agg(F.count("*").alias("n")).withColumn("rule", F.lit("repeated_member")),
        long.where(F.col("member").startswith(own)).agg(F.count("*").alias("n")).withColumn("rule", F.lit("self_match")),
        long.where(~starts).agg(F.count("*").alias("n")).withColumn("rule", F.lit("bad_prefix")),
        required.select("id").distinct().join(lists.select("id").distinct(), "id", "left_anti").agg(F.count("*").alias("n")).withColumn("rule", F.lit("missing_row")),
        lists.select("id").distinct().join(required.select("id").distinct(), "id", "left_anti").agg(F.count("*").alias("n")).withColumn("rule", F.lit("unexpected_row")),
    ]
    if valid is not None:
        unknown = long.where(starts & ~F.col("member").startswith(own)).select("member").distinct().join(valid.select(F.col("id").alias("member")), "member", "left_anti")
        counts.append(unknown.agg(F.count("*").alias("n")).withColumn("rule", F.lit("unknown_member")))
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out.where("n > 0").select("rule", "n")


def outside_candidates(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Matched (query, candidate) that the candidate lists don't have: a warning."""
    return matches.select("query", "candidate").distinct().join(candidates.select("query", "candidate"), ["query", "candidate"], "left_anti")


def file_problems(text_lines: DataFrame, header: tuple[str, str]) -> DataFrame:
    """(rule, n) for the lines (value, number from 0) of a list file: comma_header, bad_header, row_without_tab, empty_file."""
    first = text_lines.where("number = 0").agg(F.max("value").alias("value"))
    told = F.transform(F.split(F.coalesce("value", F.lit("")), "\t"), lambda x: F.lower(F.trim(x)))
    rule = F.when(F.col("value").isNull(), "empty_file").when(~F.col("value").contains("\t") & F.col("value").contains(","), "comma_header").when(told != F.array(*map(F.lit, header)), "bad_header")
    heads = first.select(rule.alias("rule"), F.lit(1).cast("long").alias("n")).where("rule is not null")
    rows = text_lines.where((F.col("number") > 0) & (F.trim("value") != "") & ~F.col("value").contains("\t")).agg(F.count("*").alias("n")).where("n > 0")
    return heads.unionByName(rows.select(F.lit("row_without_tab").alias("rule"), "n"))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_rows, n_blank): nulls and blank values of each column in one pass."""
    blank = lambda c: F.sum(F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), 1).otherwise(0))
    row = df.agg(F.count("*").alias("n_rows"), *(F.coalesce(blank(c), F.lit(0)).alias(f"b{i}") for i, c in enumerate(columns)))
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"b{i}").cast("long").alias("n_blank")) for i, c in enumerate(columns)))
    return row.select("n_rows", F.explode(pairs).alias("x")).select("x.column", "n_rows", "x.n_blank")


def distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def truth_summary(lists: DataFrame) -> DataFrame:
    """One row about (query, members array): counts, share without members, mean, and members by source prefix."""
    size = F.size("members")
    of = lambda p: F.sum(F.size(F.filter("members", lambda m: m.startswith(p))))
    return lists.agg(
        F.count("*").alias("n"),
        F.sum((size == 0).cast("long")).alias("n_single"),
        F.round(100 * F.avg((size == 0).cast("double")), 2).alias("single_percent"),
        F.sum((size > 0).cast("long")).alias("n_matched"),
        F.sum(size.cast("long")).alias("n_members"),
        F.round(F.avg(size), 3).alias("mean_members"),
        of("S2-").alias("n_s2"),
        of("S3-").alias("n_s3"),
    )


def size_histogram(lists: DataFrame, top: int = 10) -> DataFrame:
    """The `top` most frequent list sizes (a report), ties by size."""
    return lists.groupBy(F.size("members").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").limit(top)


def examples(df: DataFrame, column: str, n: int = 5) -> list:
    """The first n distinct values in order: what a report shows of an issue."""
    return [r[0] for r in df.select(column).distinct().orderBy(column).limit(n).collect()]


def write_profile(df: DataFrame, columns: list[str], path: str) -> None:
    """The profile as CSV with a header, and each row as JSON: path/csv and path/json."""
    rows = profile(df, columns)
    rows.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    rows.write.mode("overwrite").json(f"{path}/json")
