"""Path handling: one spelling per file, literal paths in globs, scratch folders."""

from __future__ import annotations

import atexit
import hashlib
import os
import re
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def scanned_path() -> Column:
    """Path of the file a scanned row came from, spelled as a directory listing spells it.

    File metadata holds a percent-encoded URI while listings hold the plain path. The decoder
    is a form decoder, so a literal plus sign is protected first.
    """
    encoded = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))
    return normalized_path(F.url_decode(encoded))


def normalized_path(path: Column) -> Column:
    """Collapse the slashes after the local scheme: file:///a and file:/a are one file."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def normalize(path: str) -> str:
    return re.sub("^file:/+", "file:/", path)


def source_key(path: str) -> str:
    """Key of a source file; equals ``md5`` of the normalized path in Spark."""
    return hashlib.md5(path.encode("utf-8")).hexdigest()


def glob_escape(path: str) -> str:
    """Make a path literal: the readers treat every path they get as a glob."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def qualify(spark: SparkSession, path: str) -> str:
    """Absolute path with its scheme, as the session's file systems spell it."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    return normalize(fs.makeQualified(jpath).toString())


@cache
def _local_scratch() -> str:
    """A folder of this process, removed at its end."""
    path, owner = tempfile.mkdtemp(prefix="lakeload-"), os.getpid()

    def remove() -> None:
        if os.getpid() == owner:  # not at the end of a process that was forked off
            shutil.rmtree(path, ignore_errors=True)

    atexit.register(remove)
    return path


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder name under the session's shared checkpoint folder.

    A machine-local folder is made only in local mode, and only when no shared one is named; it goes
    with the process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        base = "file:" + _local_scratch()
    return qualify(spark, f"{base.rstrip('/')}/lakeload-{label}-{uuid.uuid4().hex}")
