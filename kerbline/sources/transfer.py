"""Copying files between stores that Spark reaches, and opening archives there. No network protocol of its own: a store's connector does that."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def children(spark: SparkSession, folder: str, pattern: str = "*") -> list[str]:
    """Names of a folder's files that fit the pattern, sorted; none if it doesn't exist."""
    place, fs = _fs(spark, f"{folder.rstrip('/')}/{pattern}")
    found = fs.globStatus(place)
    return sorted(s.getPath().getName() for s in (found or []) if s.isFile())


def copy_children(spark: SparkSession, source: str, target: str, pattern: str = "*") -> tuple[list[str], dict[str, str]]:
    """(copied names, name -> failure): each file is copied by itself, over one of its name; a failure doesn't stop the others."""
    copied, failed = [], {}
    to, to_fs = _fs(spark, target)
    to_fs.mkdirs(to)
    for name in children(spark, source, pattern):
        here, here_fs = _fs(spark, f"{source.rstrip('/')}/{name}")
        there, there_fs = _fs(spark, f"{target.rstrip('/')}/{name}")
        try:
            if not spark._jvm.org.apache.hadoop.fs.FileUtil.copy(here_fs, here, there_fs, there, False, True, spark._jsc.hadoopConfiguration()):
                raise OSError("not copied")
            copied.append(name)
        except Exception as error:  # a store's own errors differ
            failed[name] = str(error).splitlines()[0]
    return copied, failed


def publish(spark: SparkSession, source: str, root: str, date: str, pattern: str = "*") -> list[str]:
    """Copy a folder's files to the dated folder below ``root``, made if need be; files of equal names are replaced. Raises if any fails."""
    copied, failed = copy_children(spark, source, f"{root.rstrip('/')}/{date}", pattern)
    if failed:
        raise OSError(f"not published: {failed}")
    return copied


def archive_members(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """(archive, name, content) of the members of zip archives below ``path``, one archive per task; broken archives give none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, data in zip(batch["path"], batch["content"]):
                try:
                    opened = zipfile.ZipFile(io.BytesIO(data))
                except zipfile.BadZipFile:
                    continue
                for name in opened.namelist():
                    if not name.endswith("/") and (not suffixes or name.lower().endswith(suffixes)):
                        yield pd.DataFrame({"archive": [archive], "name": [name], "content": [opened.read(name)]})

    return files.mapInPandas(run, "archive string, name string, content binary")


def extract(spark: SparkSession, path: str, target: str, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """Unpack text members of archives to ``target`` as (archive, name, line) rows and read them back."""
    lines = archive_members(spark, path, suffixes).select("archive", "name", F.posexplode(F.split(F.decode("content", "UTF-8"), "\r?\n")).alias("at", "line"))
    lines.write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)
