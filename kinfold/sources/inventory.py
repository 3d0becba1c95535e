"""File inventories: size and SHA-256 of every file below a folder, and their verification."""

from __future__ import annotations

import hashlib
from typing import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

BLOCK = 8 << 20


def _digest(path: str) -> str:
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    digest = hashlib.sha256()
    with system.open_input_stream(inner) as stream:
        while chunk := stream.read(BLOCK):
            digest.update(chunk)
    return digest.hexdigest()


def _hash_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        batch["sha256"] = [_digest(p) for p in batch["path"]]
        yield batch


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """``(path, bytes, sha256)`` with paths relative to ``root``.

    Only path and length come from the listing; contents are streamed through the hash in blocks on
    the executors, so a file larger than memory is fine and nothing passes through the driver.
    """
    listing = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        .select("path", F.col("length").alias("bytes"))
    )
    hashed = listing.mapInPandas(_hash_files, "path string, bytes bigint, sha256 string")
    base = root.rstrip("/").split("://")[-1] + "/"
    return hashed.select(F.substring_index("path", base, -1).alias("path"), "bytes", "sha256")


def verify_inventory(expected: DataFrame, actual: DataFrame, forbidden: Sequence[str],
                     max_bytes: int) -> DataFrame:
    """Status per path: ok / missing / mismatch / unlisted / forbidden_suffix / too_large."""
    e = expected.select("path", F.col("bytes").alias("want_bytes"), F.col("sha256").alias("want_sha256"))
    a = actual.select("path", F.col("bytes").alias("have_bytes"), F.col("sha256").alias("have_sha256"))
    bad_suffix = F.lit(False)
    for suffix in forbidden:
        bad_suffix = bad_suffix | F.lower("path").endswith(suffix)
    status = (
        F.when(F.col("have_sha256").isNull(), "missing")
        .when(bad_suffix, "forbidden_suffix")
        .when(F.col("have_bytes") > max_bytes, "too_large")
        .when(F.col("want_sha256").isNull(), "unlisted")
        .when((F.col("want_sha256") != F.col("have_sha256")) | (F.col("want_bytes") != F.col("have_bytes")), "mismatch")
        .otherwise("ok")
    )
    return e.join(a, "path", "full_outer").select("path", status.alias("status"))


def stage_status(markers: DataFrame, actual: DataFrame) -> DataFrame:
    """A stage is valid when every output it recorded exists with the recorded hash."""
    found = markers.join(actual.select("path", F.col("sha256").alias("have")), "path", "left")
    good = F.coalesce(F.col("have") == F.col("sha256"), F.lit(False))
    return found.groupBy("stage").agg(
        F.count("*").alias("outputs"), F.count_if(good).alias("valid_outputs"),
        F.bool_and(good).alias("complete"))
