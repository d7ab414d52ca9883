"""The warehouse table: bucket and partition pruning, re-deliveries, crashes, sizes."""

import gzip
import os
import random

import pytest
from conftest import record

from lakeload.operators.lookup import lookup_by_id
from lakeload.sources import ledger, warehouse
from lakeload.sources.table import read_rejects, read_table
from lakeload.sources.warehouse import open_warehouse, publish_all
from lakeload.streaming.ingest import ingest
from lakeload.streaming.load import IngestOptions


@pytest.fixture
def name(spark):
    made = f"lakeload_{os.urandom(6).hex()}"
    yield made
    spark.sql(f"DROP TABLE IF EXISTS {made}")


def deliver(spark, inbox, name, known=True, options=None, **files):
    for file, rows in files.items():
        inbox.put(f"{file}.tsv.gz", rows)
    options = options or IngestOptions(warehouse=name, buckets=4, ignore_duplicates=known)
    return ingest(spark, inbox.folder, inbox.root, options=options)


def held(spark, name):
    rows = spark.table(name).select("ID", "Library_ID", "Sub_ID_1").collect()
    return sorted((tuple(r) for r in rows), key=str)


def data_files(inbox):
    found = []
    for base, _, names in os.walk(f"{inbox.root}/warehouse"):
        found += [os.path.join(base, n) for n in names if n.endswith(".parquet")]
    return found


def scan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)


def test_a_lookup_over_fifty_sources_reads_one_bucket(spark, inbox, name):
    files = {f"f{i}": [record(f"{n:04d}", "L1") for n in range(i, 2000, 50)] for i in range(50)}
    deliver(spark, inbox, name, **files)
    assert spark.table(name).count() == 2000
    key = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
    spark.conf.set(key, "false")
    try:
        hits = lookup_by_id(spark.table(name), "0077")
        scan = scan_of(hits)
    finally:
        spark.conf.unset(key)
    assert "SelectedBucketsCount: 1 out of 4" in scan.toString()
    assert [r.ID for r in hits.collect()] == ["0077"]
    # Without the setting the planner prunes the same and does not say so: no file of another bucket
    # gives a row, and the filter on a file's range of IDs leaves a few.
    assert scan_of(lookup_by_id(spark.table(name), "0077")).metrics().apply("numOutputRows").value() < 600


def test_rows_of_a_bucket_are_ordered_and_those_of_an_id_are_together(spark, inbox, name):
    deliver(spark, inbox, name, a=[record(f"{n * 7919 % 1000:04d}", "L1") for n in range(1000)])
    seen = {}
    for path in data_files(inbox):
        stored = [r.ID for r in spark.read.parquet(path).select("ID").collect()]
        assert stored == sorted(stored)
        bucket = path.rsplit("_", 1)[1].split(".")[0]
        assert all(seen.setdefault(i, bucket) == bucket for i in stored)
    assert len(seen) == 1000 and len(set(seen.values())) == 4


def test_each_load_registers_its_partitions_and_a_library_is_listed_alone(spark, inbox, name):
    deliver(spark, inbox, name, a=[record("1", "L1"), record("2", "A/B %'x")])
    deliver(spark, inbox, name, b=[record("3", "L1")])
    assert [r[:2] for r in held(spark, name)] == [("1", "L1"), ("2", "A/B %'x"), ("3", "L1")]
    assert read_table(spark, inbox.root).count() == 0  # rows have moved
    scan = scan_of(lookup_by_id(spark.table(name), "2", "A/B %'x"))
    assert scan.metrics().apply("numPartitions").value() == 1
    assert scan.metrics().apply("numFiles").value() == 1
    assert lookup_by_id(spark.table(name), "2", "none").collect() == []


def test_a_redelivery_replaces_rows_and_drops_libraries_left(spark, inbox, name):
    deliver(spark, inbox, name, a=[record("1", "A/B %'x"), record("2", "L2")], b=[record("3", "L2")])
    deliver(spark, inbox, name, known=False, a=[record("1", "L3", Sub_ID_1="new")])
    expected = [("1", "L3", "new"), ("3", "L2", "s1")]
    assert held(spark, name) == expected
    assert len({os.path.dirname(p) for p in data_files(inbox)}) == 2
    deliver(spark, inbox, name, known=False, a=[record("1", "L3", MW="bad")])
    assert held(spark, name) == [("3", "L2", "s1")]
    assert read_rejects(spark, inbox.root).count() == 1
    counts = {os.path.basename(r.path): r.rows_loaded for r in deliver(spark, inbox, name).collect()}
    assert counts == {"a.tsv.gz": 0, "b.tsv.gz": 1}


def test_a_row_without_library(spark, inbox, name):
    options = IngestOptions(warehouse=name, buckets=4, level="staging", ignore_duplicates=False)
    deliver(spark, inbox, name, options=options, a=[record("1", None), record("2", "L")])
    assert held(spark, name) == [("1", None, "s1"), ("2", "L", "s1")]
    deliver(spark, inbox, name, options=options, a=[record("2", "L")])
    assert held(spark, name) == [("2", "L", "s1")]
    assert len(data_files(inbox)) == 1


@pytest.mark.parametrize("step", ["_insert", "_drop", "remove_folder"])
def test_a_crash_neither_loses_nor_doubles_rows(spark, inbox, name, monkeypatch, step):
    deliver(spark, inbox, name, a=[record("1"), record("2", "L2")], b=[record("3")])

    def crash(*_):
        raise InterruptedError

    with monkeypatch.context() as patched:
        patched.setattr(warehouse, step, crash)
        patched.setattr("lakeload.streaming.load._is_systemic", lambda _: True)
        with pytest.raises(Exception):  # noqa: B017
            deliver(spark, inbox, name, known=False, a=[record("4")], c=[record("5")])
    deliver(spark, inbox, name, known=False)
    assert [r[0] for r in held(spark, name)] == ["3", "4", "5"]


def test_a_damaged_redelivery_keeps_rows(spark, inbox, name):
    deliver(spark, inbox, name, a=[record(str(i)) for i in range(200)])
    inbox.put_bytes("a.tsv.gz", gzip.compress(os.urandom(5000))[:2000])
    deliver(spark, inbox, name, known=False)
    assert len(held(spark, name)) == 200
    entry = ledger.latest_entries(ledger.read_ledger(spark, inbox.root)).first()
    assert (entry.status, entry.rows_loaded) == (ledger.QUARANTINED, 200)


def test_a_catalog_that_forgot_finds_the_partitions_again(spark, inbox, name):
    deliver(spark, inbox, name, a=[record("1", "00")])
    spark.sql(f"DROP TABLE {name}")
    assert [r.Library_ID for r in open_warehouse(spark, name, inbox.root, 4).collect()] == ["00"]
    with pytest.raises(ValueError):
        open_warehouse(spark, name, inbox.root, 8)
    with pytest.raises(ValueError):
        open_warehouse(spark, name, inbox.root + "-other", 4)


def test_a_table_loaded_before_moves(spark, inbox, name):
    deliver(spark, inbox, name, options=IngestOptions(), a=[record("1")], b=[record("2", "L2")])
    assert publish_all(spark, name, inbox.root, at_once=1) == 2
    assert [r[0] for r in held(spark, name)] == ["1", "2"]
    assert publish_all(spark, name, inbox.root) == 0
    assert sum(warehouse.held_rows(spark, name, [r.src for r in spark.table(name).collect()]).values()) == 2
    assert warehouse.held_rows(spark, name, []) == {}


def test_tiny_libraries_share_tasks_and_a_hot_one_is_split(spark, inbox, name):
    """100 libraries of a row each and one with thirty times as many rows.

    What one task has read stays together, so the source is spread over eight ranges first, and
    tasks read little at a time.
    """

    def vector():
        return "".join(random.choices("0123456789,", k=400))

    rows = [record(f"t{i}", f"L{i}", FP1=vector()) for i in range(100)]
    rows += [record("HOT", "hot", FP1=vector()) for i in range(3000)]
    inbox.put("a.gz", rows)
    small = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.files.maxPartitionBytes": "128k",
        "spark.sql.files.openCostInBytes": "1k",
    }
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        deliver(spark, inbox, name, options=IngestOptions(warehouse=name, buckets=4, partitions=8))
    finally:
        for key in small:
            spark.conf.unset(key)
    assert spark.table(name).count() == 3100
    hot = [p for p in data_files(inbox) if "Library_ID=hot" in p]
    tiny = [p for p in data_files(inbox) if "Library_ID=hot" not in p]
    assert len(hot) > 3 and len(tiny) == 100
    sizes = sorted(os.path.getsize(p) for p in hot)
    assert sizes[-1] < 4 * (64 << 10)
    tasks = {os.path.basename(p).split("-")[1] for p in tiny}
    assert len(tasks) < 30, len(tasks)
    assert lookup_by_id(spark.table(name), "HOT").count() == 3000
