"""Result tables, metadata, reports, models and their manifest in shared storage."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plantwatch.session import fresh_path, shared_dir, ship_package


def write_table(df: DataFrame, label: str, partition_by: list[str] | None = None, fmt: str = "parquet") -> str:
    """Write a result table into the shared folder and return its path."""
    path = fresh_path(df.sparkSession, label)
    writer = df.write.format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


def read_operating_mode(spark: SparkSession, path: str, mode: str) -> DataFrame:
    """One operating mode of a stored result table, with its number of evaluated rows."""
    return (spark.read.parquet(path).filter(F.col("operating_mode") == mode)
            .withColumn("rows", F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")))


def write_metadata(df: DataFrame, label: str) -> str:
    return write_table(df, label, fmt="json")


def read_metadata(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_report(df: DataFrame, line: Column, label: str) -> str:
    """Text rendering of a result table, one line per row."""
    path = fresh_path(df.sparkSession, label)
    df.select(line.alias("value")).write.text(path)
    return path


#: Files up to this size are read as one value; longer ones are hashed block by block.
WHOLE_FILE = 64 << 20
BLOCK = 8 << 20


def artifact_manifest(spark: SparkSession, path: str, glob: str = "*", whole: int = WHOLE_FILE) -> DataFrame:
    """Path, size and SHA-256 of every file below a folder; files are hashed in parallel.

    A file above ``whole`` bytes passes through its task in blocks, so its size has no limit.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", glob).load(path))
    small = files.filter(F.col("length") <= whole).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    big = files.filter(F.col("length") > whole).select("path", F.col("length").alias("bytes"))
    ship_package(spark)
    return small.unionByName(big.repartition("path").mapInPandas(_hash_files, "path string, bytes bigint, sha256 string"))


def _hash_files(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for files in frames:
        yield files.assign(sha256=[_sha256(p) for p in files["path"]])


def _sha256(path: str) -> str:
    digest = hashlib.sha256()
    # Spark writes local paths with one slash.
    uri = re.sub("^file:/+", "file:///", path)
    store, name = FileSystem.from_uri(uri) if ":/" in uri else (LocalFileSystem(), uri)
    with store.open_input_stream(name) as stream:
        while block := stream.read(BLOCK):
            digest.update(block)
    return digest.hexdigest()


def model_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/models/{name}"
