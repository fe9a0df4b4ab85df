"""Work done once per distinct input, and embeddings kept in a table keyed by content."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Encoder = Callable[[list[str]], np.ndarray]


def once_per_value(df: DataFrame, column: str, out: str, f: Callable) -> DataFrame:
    """df with out = f(column), evaluated once for each distinct value. Worth its shuffle only where f is dear."""
    values = df.select(column).distinct().withColumn(out, f(F.col(column)))
    return df.join(values, column, "left")


def hashing_encoder(dim: int = 64, n: int = 3) -> Encoder:
    """Character n-grams hashed to a unit vector; the same in every process."""
    import zlib

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for k, t in enumerate(texts):
            for i in range(max(1, len(t) - n + 1)):
                h = zlib.crc32(t[i : i + n].encode())
                out[k, h % dim] += 1.0 if h >> 31 else -1.0
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, size, out=np.zeros_like(out), where=size > 0)

    return encode


def patient(encoder: Encoder, tries: int = 3, wait: float = 1.0) -> Encoder:
    """encoder with retries (waits double each time) for a batch, then one text at a time, so that one text that can't be
    encoded fails alone; its error is raised."""

    def tried(texts: list[str]) -> np.ndarray:
        for k in range(tries):
            try:
                return encoder(texts)
            except Exception:
                if k == tries - 1:
                    raise
                time.sleep(wait * 2**k)
        raise ValueError("tries must be positive")

    def encode(texts: list[str]) -> np.ndarray:
        try:
            return tried(texts)
        except Exception:
            if len(texts) < 2:
                raise
            return np.vstack([tried([t]) for t in texts])

    return encode


def encoded(df: DataFrame, id_col: str, text_col: str, encoder: Encoder) -> DataFrame:
    """(id, vector): the encoder sees batches of texts; a model is loaded once per task. id keeps its type."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "vector": list(encoder(pdf["text"].fillna("").tolist()).astype("float64"))})

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, vector array<double>")


def missing_from(df: DataFrame, cache: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of df whose (id, content) the cache (id, content) doesn't have: those to encode anew."""
    keyed = df.withColumn("content", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    return keyed.join(cache.select(F.col("id").alias(id_col), "content"), [id_col, "content"], "left_anti")


def cached_vectors(df: DataFrame, path: str, id_col: str, text_col: str, encoder: Encoder) -> DataFrame:
    """(id, vector) of df by a table of (id, content, vector) at path: what it lacks is encoded and appended, one new set of
    files per call, and the rest is read. Texts that changed have another content, so their old vectors are left unused."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, content string, vector array<double>"
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    table = lambda: spark.read.schema(schema).parquet(path)
    new = missing_from(rows.distinct(), table(), "id", "text")
    codes = new.select("content", "text").distinct()  # equal texts are encoded once
    vectors = encoded(codes, "content", "text", encoder).withColumnRenamed("id", "content")
    new.select("id", "content").join(vectors, "content").select("id", "content", "vector").write.mode("append").parquet(path)
    keyed = rows.select("id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content"))
    return keyed.join(table().dropDuplicates(["id", "content"]), ["id", "content"]).select("id", "vector")
