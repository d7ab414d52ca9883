"""Folders and single files on any storage, from the driver and from inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lakeload.functions.paths import glob_escape
from lakeload.sources import storage
from lakeload.sources.storage import resolve

Batches = Iterator[pa.RecordBatch]


def make_folder(spark: SparkSession, path: str) -> None:
    """Make a folder and its parents; nothing happens when it is there."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(jpath)


def remove_folder(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if there is no such folder."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(jpath)] if fs.exists(jpath) else []


def _facts(path: str) -> Iterator[dict]:
    fs, inside = resolve(path)
    info = fs.get_file_info(inside)
    if info.type == pafs.FileType.File:
        yield {"path": path, "length": info.size, "modificationTime": info.mtime}


def file_facts(files: DataFrame) -> DataFrame:
    """``path``, ``length`` and ``modificationTime`` of the files in column ``path`` that exist."""
    return flat_map_paths(files, _facts, "path string, length long, modificationTime timestamp")


def path_frame(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """A bounded list of paths as a DataFrame, spread over the cluster's cores."""
    return spark.createDataFrame([(path,) for path in paths], "path string")


def map_paths(files: DataFrame, function: Callable[[str], dict], schema: str) -> DataFrame:
    """Call ``function`` on each value of column ``path`` inside the tasks; one row each."""
    return flat_map_paths(files, lambda path: [function(path)], schema)


def flat_map_paths(
    files: DataFrame, function: Callable[[str], Iterable[dict]], schema: str
) -> DataFrame:
    """Call ``function`` on each value of column ``path`` inside the tasks; a row for each result.

    The session's storage settings go along, as they are now.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    settings = storage.session_settings(files.sparkSession)

    def work(batches: Batches) -> Batches:
        storage.use(settings)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                found = iter(function(path))
                while rows := list(islice(found, 10_000)):
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.select("path").mapInArrow(work, schema)


LISTED = "path string, is_folder boolean, length long, modificationTime timestamp"


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _children(path: str) -> Iterator[dict]:
    fs, inside = resolve(path)
    for info in fs.get_file_info(pafs.FileSelector(inside, recursive=False)):
        if not _hidden(info.base_name):
            is_folder = info.type == pafs.FileType.Directory
            yield {
                "path": f"{path.rstrip('/')}/{info.base_name}",
                "is_folder": is_folder,
                "length": None if is_folder else info.size,
                "modificationTime": info.mtime,
            }


def children(folders: DataFrame) -> DataFrame:
    """What lies directly in each of the folders: files, and folders with ``is_folder``.

    Each folder is listed inside a task, none of them walked. One that does not exist is an error.
    """
    return flat_map_paths(folders, _children, LISTED)


def _remove(path: str) -> dict:
    fs, inside = resolve(path)
    targets = [inside]
    if isinstance(fs, pafs.LocalFileSystem):
        # Hadoop's local file system keeps a checksum file next to what it writes.
        folder, _, name = inside.rpartition("/")
        targets.append(f"{folder}/.{name}.crc")
    for target in targets:
        if fs.get_file_info(target).type == pafs.FileType.File:
            try:
                fs.delete_file(target)
            except FileNotFoundError:
                pass  # another attempt of this task was faster
    return {"path": path}


def note_paths(paths: DataFrame, note: str) -> None:
    """Write down column ``path``, to be worked on after what it was computed from changes."""
    paths.select("path").write.mode("overwrite").parquet(note)


def remove_noted(spark: SparkSession, note: str) -> int:
    """Delete the files of a note, in parallel, then the note; returns how many it named.

    Deleting from a note, not from a listing of the files themselves: a task that is run again
    would list what it has already deleted. Absent files count as removed.
    """
    removed = remove_listed(spark, note)
    remove_folder(spark, note)
    return removed


def _remove_folder(path: str) -> dict:
    fs, inside = resolve(path)
    if fs.get_file_info(inside).type == pafs.FileType.Directory:
        try:
            fs.delete_dir(inside)
        except FileNotFoundError:
            pass  # another attempt of this task was faster
    return {"path": path}


def remove_noted_folders(spark: SparkSession, note: str) -> int:
    """Delete the folders of a note, in parallel, then the note; returns how many it named."""
    noted = spark.read.schema("path string").parquet(glob_escape(note))
    removed = map_paths(noted, _remove_folder, "path string").count()
    remove_folder(spark, note)
    return removed


def remove_listed(spark: SparkSession, note: str) -> int:
    """Delete the files of a note and keep the note."""
    noted = spark.read.schema("path string").parquet(glob_escape(note))
    return map_paths(noted, _remove, "path string").count()


def _is_folder(path: str) -> dict:
    fs, inside = resolve(path)
    return {"path": path, "found": fs.get_file_info(inside).type == pafs.FileType.Directory}


def existing_folders(spark: SparkSession, candidates: list[str]) -> list[str]:
    """Those of the candidate folders that exist; looked up in parallel, one call for each.

    Cheaper than a listing of what surrounds them, which grows with the table.
    """
    if not candidates:
        return []
    looked_up = map_paths(
        path_frame(spark, candidates), _is_folder, "path string, found boolean"
    )
    return sorted(row.path for row in looked_up.filter("found").collect())
