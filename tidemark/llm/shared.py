"""Lineage cuts and shared-folder file access used by the operators of this subpackage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see (spark.checkpoint.dir).

    Where the session has none, one is set only if the session runs on this machine alone; on a
    cluster executors would write to disks of their own, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            found = jvm_dir.get()
        elif re.match(r"local(\[|$)", spark.sparkContext.master):
            found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_dir(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame, kind: str = "cut") -> DataFrame:
    """Write a table to the shared folder and read it back: ends the lineage, survives lost
    executors, and gives the planner real sizes."""
    spark = df.sparkSession
    path = new_dir(spark, kind)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(columns: list[str], of: str | None = None) -> Column:
    """128 bits of all columns of a row, nulls told apart; equal rows have equal keys."""
    name = lambda c: F.col(f"{of}.`{c}`" if of else f"`{c}`")
    return F.md5(F.to_json(F.struct(*[name(c).alias(f"c{i}") for i, c in enumerate(columns)])))


def local_path(uri: str) -> str | None:
    """The path of a file: URI or plain path, None for other stores."""
    if re.match(r"file:", uri):
        return re.sub(r"^file:(//[^/]*)?", "", uri)
    return None if re.match(r"[a-z][a-z0-9+.-]*:", uri) else uri


def write_bytes(uri: str, parts) -> int:
    """Write chunks to a file of the shared folder; a repeated attempt replaces it whole."""
    path, n = local_path(uri), 0
    if path is None:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        with store.open_output_stream(path) as out:
            for x in parts:
                n += len(x)
                out.write(x)
        return n
    os.makedirs(os.path.dirname(path), exist_ok=True)
    attempt = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(attempt, "wb") as out:
        for x in parts:
            n += len(x)
            out.write(x)
    os.replace(attempt, path)
    return n


def open_input(uri: str):
    """A seekable binary file of the shared folder."""
    path = local_path(uri)
    if path is not None:
        return open(path, "rb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)
