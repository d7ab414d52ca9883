"""Finding input files. A set of files is a DataFrame with a column ``path``."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lakeload.functions.paths import normalized_path, qualify, scratch_dir
from lakeload.sources.files import LISTED, children, path_frame

DEFAULT_EXTENSION = ".gz"

# What is known of a file in a listing.
LISTING = "path string, length long, modificationTime timestamp"


def discover_files(
    spark: SparkSession,
    folder: str,
    extension: str = DEFAULT_EXTENSION,
    recursive: bool = False,
) -> DataFrame:
    """Files with the extension in a folder: ``path``, ``length`` and ``modificationTime``.

    Folders are listed inside tasks, level by level, a folder a row, so the driver holds none of the
    names; without ``recursive`` no other folder is entered. Names that Spark's readers pass over are
    not listed. Full paths are kept. Files without a single byte are not listed; they appear once they
    have content.
    """
    level = children(path_frame(spark, [qualify(spark, folder)]))
    if not recursive:
        return _files(level, extension)
    found = []
    while True:
        level, n_folders = _noted(level)
        found.append(_files(level, extension))
        if not n_folders:
            return reduce(DataFrame.union, found)
        # A folder is a row, so a task's share is some of them, however few rows there are.
        tasks = min(n_folders, 4 * spark.sparkContext.defaultParallelism)
        level = children(level.where("is_folder").select("path").repartition(tasks))


def _noted(level: DataFrame) -> tuple[DataFrame, int]:
    """A level of the walk, written down, and its number of folders, counted as they are written.

    The next level starts from it, and it is listed once.
    """
    spark, seen = level.sparkSession, Observation()
    path = scratch_dir(spark, "listing")
    level.observe(seen, F.count_if("is_folder").alias("folders")).write.parquet(path)
    return spark.read.schema(LISTED).parquet(path), seen.get["folders"]


def _files(level: DataFrame, extension: str) -> DataFrame:
    wanted = ~F.col("is_folder") & (F.col("length") > 0) & F.endswith("path", F.lit(extension))
    return level.where(wanted).select(normalized_path(F.col("path")).alias("path"), "length", "modificationTime")


def listed_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Explicitly named files in the given order; they need not match any extension."""
    rows = [(qualify(spark, path), position) for position, path in enumerate(paths)]
    return spark.createDataFrame(rows, "path string, position long")


def combine_files(listed: DataFrame, discovered: DataFrame) -> DataFrame:
    """Listed files ahead of discovered ones, each path once, at its first position.

    Columns ``path`` and ``position``; discovered files have no position and follow by path.
    """
    both = listed.select("path", "position").unionByName(
        discovered.select("path", F.lit(None).cast("long").alias("position"))
    )
    return both.groupBy("path").agg(F.min("position").alias("position"))


def in_order(files: DataFrame) -> DataFrame:
    return files.orderBy(F.col("position").asc_nulls_last(), "path")
