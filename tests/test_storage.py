"""Storage settings of tasks, listing in tasks, the bucketed ledger, and the stream's state."""

import os
import re

import pytest
from conftest import record
from pyspark.sql import functions as F

from lakeload.functions.paths import qualify, source_key
from lakeload.sources import ledger, storage
from lakeload.sources.discovery import discover_files
from lakeload.sources.files import children, path_frame
from lakeload.sources.ledger import ENTRY_SCHEMA, append_entries, merge_loads, read_entries, read_ledger, unconsumed
from lakeload.sources.table import read_table
from lakeload.streaming import ingest as ingest_module
from lakeload.streaming.ingest import ingest, ingest_stream
from lakeload.streaming.load import IngestOptions
from lakeload.streaming.progress import report, watched

# Settings


@pytest.mark.parametrize(
    "scheme, authority, settings, expected",
    [
        ("s3a", "b", {}, None),
        (
            "s3a",
            "b",
            {"fs.s3a.access.key": "k", "fs.s3a.secret.key": "s", "fs.s3a.endpoint.region": "r"},
            ("S3FileSystem", {"access_key": "k", "secret_key": "s", "region": "r"}),
        ),
        (
            "s3a",
            "own",
            {"fs.s3a.access.key": "k", "fs.s3a.bucket.own.access.key": "k2", "fs.s3a.bucket.other.access.key": "k3"},
            ("S3FileSystem", {"access_key": "k2"}),
        ),
        (
            "s3",
            "b",
            {"fs.s3a.endpoint": "http://host:9000", "fs.s3a.path.style.access": "true"},
            ("S3FileSystem", {"endpoint_override": "host:9000", "force_virtual_addressing": False, "scheme": "http"}),
        ),
        (
            "s3n",
            "b",
            {"fs.s3a.endpoint": "host", "fs.s3a.connection.ssl.enabled": "false"},
            ("S3FileSystem", {"endpoint_override": "host", "force_virtual_addressing": True, "scheme": "http"}),
        ),
        (
            "s3a",
            "b",
            {"fs.s3a.aws.credentials.provider": "org.apache.hadoop.fs.s3a.AnonymousAWSCredentialsProvider"},
            ("S3FileSystem", {"anonymous": True}),
        ),
        (
            "abfss",
            "box@acct.dfs.core.windows.net",
            {"fs.azure.account.key.acct.dfs.core.windows.net": "k", "fs.azure.account.key.x.dfs.core.windows.net": "no"},
            ("AzureFileSystem", {"account_name": "acct", "account_key": "k"}),
        ),
        (
            "abfs",
            "box@acct.dfs.core.windows.net",
            {
                "fs.azure.account.oauth2.client.id": "i",
                "fs.azure.account.oauth2.client.secret": "s",
                "fs.azure.account.oauth2.client.endpoint": "https://login.example/TENANT/oauth2/token",
            },
            (
                "AzureFileSystem",
                {"account_name": "acct", "client_id": "i", "client_secret": "s", "tenant_id": "TENANT"},
            ),
        ),
        ("gs", "b", {"fs.gs.project.id": "p"}, ("GcsFileSystem", {"project_id": "p"})),
        ("hdfs", "n:8020", {"fs.s3a.access.key": "k"}, None),
    ],
)
def test_settings_are_mapped_by_scheme(scheme, authority, settings, expected):
    assert storage.options_for(settings, scheme, authority) == expected


def test_only_wanted_settings_leave_the_session(spark):
    conf = spark._jsc.hadoopConfiguration()
    given = {"fs.s3a.bucket.b-1.secret.key": "s", "fs.azure.account.key.a.dfs.core.windows.net": "k", "fs.s3a.fast.upload": "x"}
    for key, value in given.items():
        conf.set(key, value)
    try:
        found = storage.session_settings(spark)
    finally:
        for key in given:
            conf.unset(key)
    assert {k: found.get(k) for k in given} == {**given, "fs.s3a.fast.upload": None}
    assert all(re.match(storage.WANTED, key) for key in found)


def test_resolve_opens_what_the_settings_name(monkeypatch):
    opened = []

    class Store:
        def __init__(self, **arguments):
            opened.append(arguments)

    monkeypatch.setattr(storage.pafs, "S3FileSystem", Store)
    monkeypatch.setattr(storage.pafs, "AzureFileSystem", Store, raising=False)
    storage.use({"fs.s3a.access.key": "k", "fs.azure.account.key.a.dfs.core.windows.net": "z"})
    try:
        assert storage.resolve("s3a://bucket/a b/%41.gz")[1] == "bucket/a b/%41.gz"
        assert storage.resolve("abfss://box@a.dfs.core.windows.net/x/y")[1] == "box/x/y"
        assert storage.resolve("file:/a/b")[1] == "/a/b"
    finally:
        storage.use({})
    assert opened == [{"access_key": "k"}, {"account_name": "a", "account_key": "z"}]


# Listing


def test_a_flat_listing_enters_no_folder(spark, inbox):
    inbox.put("a.gz", [record("1")])
    inbox.put("deep/er/b.gz", [record("2")])
    inbox.put("k=1/_c.gz", [record("3")])
    inbox.put(".hidden/d.gz", [record("4")])
    inbox.put_bytes("empty.gz", b"")
    os.chmod(inbox.folder + "/deep", 0)
    try:
        assert [os.path.basename(r.path) for r in discover_files(spark, inbox.folder).collect()] == ["a.gz"]
    finally:
        os.chmod(inbox.folder + "/deep", 0o755)
    found = discover_files(spark, inbox.folder, recursive=True)
    assert sorted(os.path.basename(r.path) for r in found.collect()) == ["a.gz", "b.gz"]
    row = found.where(F.endswith("path", F.lit("/a.gz"))).first()
    assert row.path == qualify(spark, inbox.folder) + "/a.gz"
    assert row.length == os.path.getsize(inbox.folder + "/a.gz")
    assert abs(row.modificationTime.timestamp() - os.path.getmtime(inbox.folder + "/a.gz")) < 1


def test_a_folder_that_is_not_there_is_an_error(spark, inbox):
    with pytest.raises(Exception, match="absent"):  # noqa: B017
        discover_files(spark, inbox.folder + "/absent").collect()


def test_names_are_listed_in_tasks(spark, inbox):
    for i in range(40):
        inbox.put(f"d{i % 10}/f{i}.gz", [record(str(i))])
    listed = children(path_frame(spark, [qualify(spark, inbox.folder)]))
    assert listed.where("is_folder").count() == 10
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FileScan" not in plan
    assert discover_files(spark, inbox.folder, recursive=True).count() == 40


# Ledger


def entries(spark, paths, status="loaded"):
    at = spark.sql("SELECT now()").first()[0]
    rows = [(p, source_key(p), status, None, 1, 1, 0, 0, [], at) for p in paths]
    return spark.createDataFrame(rows, ENTRY_SCHEMA)


def bucket_folders(root):
    return {b: sorted(os.listdir(f"{root}/ledger/{b}")) for b in os.listdir(f"{root}/ledger") if b.startswith("bucket=")}


def test_a_load_reads_the_buckets_of_its_own_files(spark, inbox):
    root = qualify(spark, inbox.root)
    ledger.create_ledger(spark, root)
    paths = [f"file:/in/{i}.gz" for i in range(600)]
    append_entries(entries(spark, paths), root, "l1")
    mine = paths[7:10]
    buckets = {source_key(p)[:2] for p in mine}
    read = read_entries(spark, root, mine)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and all(b in plan.split("PartitionFilters: [")[1] for b in buckets)
    files = [f for f in read.inputFiles()]
    assert {re.search("bucket=(..)/", f)[1] for f in files} == buckets
    assert {r.path for r in read.collect()} == {p for p in paths if source_key(p)[:2] in buckets}
    assert unconsumed(spark, root, [*mine, "file:/in/new.gz"]) == ["file:/in/new.gz"]
    assert unconsumed(spark, root, []) == []


def test_merged_loads_keep_every_entry(spark, inbox, monkeypatch):
    root = qualify(spark, inbox.root)
    ledger.create_ledger(spark, root)
    for load in range(5):
        append_entries(entries(spark, ["file:/in/a.gz", f"file:/in/{load}.gz"], "failed"), root, f"l{load}")
    before = sorted((r.path, r.load_id, r.status) for r in read_ledger(spark, root).collect())
    assert merge_loads(spark, root, over=5) == 0

    def crash(*_):
        raise InterruptedError

    with monkeypatch.context() as patched:
        patched.setattr(ledger, "remove_noted_folders", crash)
        with pytest.raises(InterruptedError):
            merge_loads(spark, root, over=3)
    assert {(r.path, r.load_id, r.status) for r in read_ledger(spark, root).collect()} == set(before)
    assert merge_loads(spark, root, over=3) == 1
    after = sorted((r.path, r.load_id, r.status) for r in read_ledger(spark, root).collect())
    assert after == before
    assert max(len(parts) for parts in bucket_folders(inbox.root).values()) <= 3
    append_entries(entries(spark, ["file:/in/a.gz"]), root, "l9")
    assert unconsumed(spark, root, ["file:/in/a.gz", "file:/in/0.gz"]) == ["file:/in/0.gz"]


# Stream


def test_names_are_state_and_a_new_run_sees_new_ones_only(spark, inbox, monkeypatch):
    seen = []
    real = ingest_module._load_in_rounds

    def noted(files, root, options, run_id, ask=False):
        seen.append((ask, sorted(os.path.basename(r.path) for r in files.select("path").collect())))
        return real(files, root, options, run_id, ask)

    monkeypatch.setattr(ingest_module, "_load_in_rounds", noted)
    inbox.put("a.gz", [record("1")])
    inbox.put("b.gz", [record("2")])
    ingest_stream(spark, inbox.folder, inbox.root)
    inbox.put("c.gz", [record("3")])
    ingest_stream(spark, inbox.folder, inbox.root)
    streamed = [names for ask, names in seen if ask and names]
    assert streamed == [["a.gz", "b.gz"], ["c.gz"]]
    assert all(names == [] for ask, names in seen if not ask)
    # The state is RocksDB's, and what the stream has read is removed.
    state = f"{inbox.root}/_checkpoint/state/0/0"
    assert any(name.endswith(".zip") for name in os.listdir(state))
    assert not os.path.exists(f"{inbox.root}/listings")
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_a_failed_load_comes_again(spark, inbox, monkeypatch):
    inbox.put("a.gz", [record("1")])

    def crash(*_, **__):
        raise InterruptedError

    with monkeypatch.context() as patched:
        patched.setattr(ingest_module, "load_files", crash)
        with pytest.raises(Exception):  # noqa: B017
            ingest_stream(spark, inbox.folder, inbox.root)
    inbox.put("b.gz", [record("2")])
    ingest_stream(spark, inbox.folder, inbox.root)
    assert sorted(r.ID for r in read_table(spark, inbox.root).collect()) == ["1", "2"]


def test_ages_as_intervals():
    assert ingest_module._interval("30d") == "30 days"
    assert ingest_module._interval(" 12 h ") == "12 hours"
    assert ingest_module._interval("2 weeks") == "2 weeks"


def test_a_very_late_file_is_found_by_the_ledger(spark, inbox):
    options = IngestOptions(max_file_age="1h")
    for name, at in (("a", 2 * 10**9), ("b", 2 * 10**9 + 10**6), ("late", 10**9)):
        path = inbox.put(f"{name}.gz", [record(name)])
        os.utime(path, (at, at))
        ingest(spark, inbox.folder, inbox.root, options=options)
    assert sorted(r.ID for r in read_table(spark, inbox.root).collect()) == ["a", "b", "late"]


def test_a_listener_hears_of_each_batch(spark, inbox):
    inbox.put("a.gz", [record("1"), record("2", MW="x")])
    inbox.put_bytes("b.gz", b"no gzip")
    with watched(spark) as listener:
        ingest_stream(spark, inbox.folder, inbox.root)
        ingest_stream(spark, inbox.folder, inbox.root)
        inbox.put("c.gz", [record("3")])
        ingest_stream(spark, inbox.folder, inbox.root)
    rows = report(spark, inbox.root, listener).orderBy("batch").collect()
    seen = [(r.batch, r.listed, r.new_files, r.entries, r.files_loaded, r.rows_loaded, r.rows_rejected) for r in rows]
    assert seen == [(0, 2, 2, 2, 1, 1, 1), (1, 2, 0, None, None, None, None), (2, 3, 1, 1, 1, 1, 0)]
    ingest_stream(spark, inbox.folder, inbox.root)
    assert len(listener.batches) == 3  # it has been taken off
