import gzip
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lakeload.functions.schema import COLUMNS  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("lakeload tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


def record(record_id, library="L1", **changes):
    """A valid input record; a value of None is an empty field."""
    values = {
        "ID": record_id,
        "Library_ID": library,
        "Sub_ID_1": "s1",
        "Sub_ID_2": "s2",
        "Sub_ID_3": "s3",
        "MW": "1.5",
        "LogP": "2.5",
        "FP1": "1,1",
        "FP2": "2,2",
        "FP3": "3,3",
        "FP4": "4,4",
        "FP5": "5,5",
    }
    assert set(changes) <= set(values), changes
    return {**values, **changes}


def tsv(rows, header=COLUMNS):
    """File text for records, with the columns of ``header`` in its order."""
    lines = ["\t".join(header)]
    lines += ["\t".join(row.get(name) or "" for name in header) for row in rows]
    return "\n".join(lines) + "\n"


class Inbox:
    """A folder of input files and a place for the table."""

    def __init__(self, path):
        self.folder = str(path / "in")
        self.root = str(path / "table")
        os.makedirs(self.folder)

    def put_bytes(self, name, data):
        path = os.path.join(self.folder, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as file:
            file.write(data)
        return path

    def put_text(self, name, text):
        return self.put_bytes(name, gzip.compress(text.encode("utf-8")))

    def put(self, name, rows, header=COLUMNS):
        return self.put_text(name, tsv(rows, header))


@pytest.fixture
def inbox(tmp_path):
    return Inbox(tmp_path)
