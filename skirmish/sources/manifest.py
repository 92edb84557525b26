"""File manifests: what is known, what is new, what has gone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Paths, sizes and times below a root; contents are not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
            .select("path", "length", "modificationTime", F.regexp_extract("path", "([^/]+)$", 1).alias("file_name")))


def usable(manifest: DataFrame, listing: DataFrame, key: str = "path") -> DataFrame:
    return manifest.join(listing.select(key), key, "left_semi")


def missing(manifest: DataFrame, listing: DataFrame, key: str = "path") -> DataFrame:
    return manifest.join(listing.select(key), key, "left_anti")


def unseen(listing: DataFrame, manifest: DataFrame, key: str = "path") -> DataFrame:
    """Files that are not in the manifest yet."""
    return listing.join(manifest.select(key), key, "left_anti")


def write_manifest(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").parquet(path)


def read_manifest(spark: SparkSession, path: str, root: str, glob: str = "*") -> DataFrame:
    """The stored manifest when there is one, else a fresh listing."""
    try:
        return spark.read.parquet(path)
    except Exception as e:  # no manifest yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return list_files(spark, root, glob)
