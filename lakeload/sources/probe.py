"""Looking into input files before or after a scan: header lines and gzip integrity.

The only Python that touches file bytes. Spark spreads the paths over tasks; a task reads one
file at a time in bounded pieces, whatever the file's size.
"""

from __future__ import annotations

import csv
import gzip
import re
import zlib

from pyspark.sql import DataFrame

from lakeload.sources.files import map_paths, resolve
from lakeload.sources.ledger import FAILED, QUARANTINED

# A header holds a handful of names; a longer first line is no header.
HEADER_LIMIT = 16 << 20
CHUNK = 1 << 20

PROBE_SCHEMA = (
    "path string, length long, modified long, header array<string>, status string, reason string"
)
VERIFY_SCHEMA = "path string, reason string"



class HeaderTooLong(Exception):
    """The first line does not end within the limit."""


_DAMAGE = (EOFError, gzip.BadGzipFile, zlib.error)
_NO_HEADER = (csv.Error,)


def _open(path: str):
    fs, inside = resolve(path)
    raw = fs.open_input_stream(inside, compression=None)
    return gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw


def parse_header(line: str) -> list[str]:
    """Column names of a header line, with the scan's quoting rules."""
    reader = csv.reader(
        [line], delimiter="\t", quotechar='"', escapechar="\\", doublequote=False
    )
    return next(reader)


def read_header(path: str, limit: int = HEADER_LIMIT) -> list[str] | None:
    """Names in the first line that is not blank, or None when there is no such line.

    Each piece of the file is looked at once. A line longer than ``limit`` is an error, not a
    verdict on the file: it stays pending.
    """
    with _open(path) as stream:
        pieces: list[bytes] = []  # of the line that has not ended yet
        held = 0
        while held < limit:
            chunk = stream.read(1 << 16)
            *ended, rest = re.split(rb"\r\n|\n|\r", chunk)
            for line in ended if chunk else [rest]:
                text = b"".join([*pieces, line]).decode("utf-8-sig", errors="replace")
                if text.strip():
                    return parse_header(text)
                pieces, held = [], 0
            if not chunk:
                return None
            pieces.append(rest)
            held += len(rest)
    raise HeaderTooLong(f"no line end in {limit} bytes")


def is_hidden(name: str) -> bool:
    """Whether a scan would pass over a file of this name without a word."""
    # The names Spark's file listing leaves out.
    underscored = name.startswith("_") and "=" not in name
    return underscored or name.startswith(".") or name.endswith("._COPYING_")


def _probe(path: str) -> dict:
    row = dict.fromkeys(("length", "modified", "header", "status", "reason"))
    if is_hidden(path.rpartition("/")[2]):
        return {"path": path, **row, "status": FAILED, "reason": "HIDDEN_NAME"}
    try:
        fs, inside = resolve(path)
        info = fs.get_file_info(inside)
        row["length"] = info.size
        # Before the content is read: a file replaced later has another time.
        row["modified"] = info.mtime_ns // 1_000_000 if info.mtime_ns else None
        row["header"] = read_header(path)
        if row["header"] is None:
            row.update(status=QUARANTINED, reason="NO_HEADER")
    except (*_DAMAGE, *_NO_HEADER) as error:
        row.update(status=QUARANTINED, reason=f"{type(error).__name__}: {error}")
    except Exception as error:  # one unreadable file must not fail the others
        row.update(status=FAILED, reason=f"{type(error).__name__}: {error}")
    return {"path": path, **row}


def probe_headers(files: DataFrame) -> DataFrame:
    """Header of each file in column ``path``, reading no further than its first line.

    ``status`` is null for a usable file, ``quarantined`` for one without a header or with a
    damaged start, ``failed`` for one that could not be read at all.
    """
    return map_paths(files, _probe, PROBE_SCHEMA)


def _verify(path: str) -> dict:
    try:
        with _open(path) as stream:
            while stream.read(CHUNK):
                pass
    except _DAMAGE as error:
        return {"path": path, "reason": f"{type(error).__name__}: {error}"}
    except OSError:
        pass  # storage trouble says nothing about the file
    return {"path": path, "reason": None}


def verify_files(files: DataFrame) -> DataFrame:
    """Decompress each file in column ``path`` to its end; ``reason`` is null for a sound one."""
    return map_paths(files, _verify, VERIFY_SCHEMA)
