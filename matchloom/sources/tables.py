"""Tab-separated tables, list-valued files and their guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.functions import text as T
from matchloom.sources import scratch

RECORD = ("entity_id", "business_name", "business_address", "country")
#: Names under which other layouts have an id, a name and an address.
ID_NAMES = ("entity_id", "id", "s1_id", "s2_id", "s3_id", "source1_entity_id")
NAME_NAMES, ADDRESS_NAMES = ("business_name", "name"), ("business_address", "address")


def read_tsv(spark: SparkSession, path: str | list[str], columns: tuple[str, ...] | None = RECORD, limit: int | None = None) -> DataFrame:
    """All strings, empty for missing, one row per line whatever quotes it holds. columns: required; raises if one is absent."""
    df = spark.read.option("sep", "\t").option("header", True).option("quote", "").option("mode", "PERMISSIVE").csv(path)
    absent = [c for c in columns or () if c not in df.columns]
    if absent:
        raise ValueError(f"{path} lacks {absent}")
    df = df.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns))
    return df.limit(limit) if limit else df


def guarded(spark: SparkSession, df: DataFrame, paths: list[str]) -> DataFrame:
    """df, if it has as many rows as the files have lines without their headers; else raises."""
    text = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file")).where("value <> ''")
    seen = text.agg(F.count("*").alias("lines"), F.countDistinct("file").alias("files")).first()  # a header for each file that has a line
    lines, rows = seen["lines"] - seen["files"], df.count()
    if lines != rows:
        raise ValueError(f"{rows} rows parsed from {lines} lines")
    return df


def aliased(df: DataFrame) -> DataFrame:
    """Records under their usual names, from whichever of the other layouts' columns are there."""
    some = lambda names: T.first_filled(*(F.col(n) for n in names if n in df.columns)) if any(n in df.columns for n in names) else F.lit("")
    optional = [c for c in ("city", "postal_code") if c in df.columns]
    country = F.col("country") if "country" in df.columns else F.lit("")
    return df.select(some(ID_NAMES).alias("entity_id"), some(NAME_NAMES).alias("business_name"), some(ADDRESS_NAMES).alias("business_address"), country.alias("country"), *optional)


def enrich(df: DataFrame, default_country: str = "") -> DataFrame:
    """Records with clean fields, skeleton, house, pin, state and token arrays."""
    name, address, land = (T.clean_lexical(F.col(c)) for c in ("business_name", "business_address", "country"))
    df = df.withColumns({"name_n": name, "addr_n": address, "country_n": F.when(land == "", default_country).otherwise(land)})
    return df.withColumns({"skeleton": T.skeleton(F.col("name_n")), "house": T.house_number(F.col("addr_n")), "pin": F.coalesce(T.pin_code(F.col("addr_n")), F.lit("")), "state": T.state_phrase(F.col("addr_n")), "name_tokens": T.tokens(F.col("name_n")), "addr_tokens": T.tokens(F.col("addr_n"))})


def read_lists(df: DataFrame, id_col: str, list_col: str) -> DataFrame:
    """(query, members array) of a list-valued table; also of the layout with one column per source (s2_id, s3_id)."""
    if list_col not in df.columns:
        parts = [F.when(T.without_null_words(F.col(c)) != "", T.without_null_words(F.col(c))) for c in ("s2_id", "s3_id")]
        return df.select(F.col(id_col).alias("query"), F.array_compact(F.array(*parts)).alias("members"))
    return df.select(F.col(id_col).alias("query"), T.id_list(F.col(list_col)).alias("members"))


def long_pairs(lists: DataFrame) -> DataFrame:
    return lists.select("query", F.explode("members").alias("candidate"))


def write_lists(df: DataFrame, path: str, id_col: str, list_col: str) -> None:
    """(query, list) as a tab-separated file with a header; an empty list is an empty field."""
    out = df.select(F.col(df.columns[0]).alias(id_col), F.col(df.columns[1]).alias(list_col))
    out.write.option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").option("nullValue", "").mode("overwrite").csv(path)


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df with position from 0 by a stated order, in two passes: counts per range partition, then places within each.

    The range partitions are written first: both passes must see the same bounds, which come from a sample of the rows.
    """
    spark = df.sparkSession
    parts = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    path = scratch.folder(spark, "numbered")
    parts.write.parquet(path)
    parts = spark.read.schema(parts.schema).parquet(path)
    sizes = parts.groupBy("__part").agg(F.count("*").alias("n"))
    # one row for each partition, so this window is small however large df is
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return parts.withColumn("__place", place).join(before, "__part").withColumn("position", F.col("__place") + F.col("before")).drop("__part", "__place", "n", "before")


def split_sizes(queries: DataFrame, pool: DataFrame, truth: DataFrame, n: int, per_query: int = 50) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The first n queries and n * per_query pool records by id, and the truth of those queries."""
    q = queries.orderBy("id").limit(n)
    return q, pool.orderBy("id").limit(n * per_query), truth.join(q.select(F.col("id").alias("query")), "query", "left_semi")


def find_files(spark: SparkSession, root: str, name: str) -> list[str]:
    """Paths of files of that name (or glob) anywhere below root, sorted; raises if there is none. Only names are read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(root).select("path")
    paths = sorted(r["path"] for r in found.collect())
    if not paths:
        raise FileNotFoundError(f"{name} below {root}")
    return paths
