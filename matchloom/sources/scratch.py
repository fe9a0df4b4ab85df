"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_ROOTS: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where the session names none, a folder of this machine will do if there is no other machine (a
    local master, as in tests); a cluster's session must name it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: it names the folder that driver and executors share")
    app = spark.sparkContext.applicationId
    _ROOTS[app] = _ROOTS.get(app) or "file://" + tempfile.mkdtemp(prefix="matchloom-")
    return _ROOTS[app]


def folder(spark: SparkSession, what: str) -> str:
    """A new folder name below the application's part of the shared root."""
    return f"{root(spark)}/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex[:12]}"
