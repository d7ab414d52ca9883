"""Ingest runs: increments, crashes, replays, damaged files, re-deliveries, clean-up, layout."""

import gzip
import os
import random
from dataclasses import replace

import pytest
from conftest import record, tsv
from pyspark.sql import functions as F

from lakeload.functions.paths import qualify, source_key
from lakeload.functions.schema import COLUMNS, PARTITION_COLUMNS
from lakeload.operators.lookup import lookup_by_id, preview
from lakeload.sources import ledger, table
from lakeload.sources.discovery import discover_files
from lakeload.sources.table import read_rejects, read_table, register_table
from lakeload.streaming import ingest as ingest_module
from lakeload.streaming import load
from lakeload.streaming.ingest import delete_loaded, ingest, ingest_files, ingest_stream
from lakeload.streaming.load import IngestOptions

TAKE_KNOWN = IngestOptions(ignore_duplicates=False)


def ids(spark, inbox):
    return sorted(r.ID for r in read_table(spark, inbox.root).select("ID").collect())


def states(spark, inbox):
    last = ledger.latest_entries(ledger.read_ledger(spark, inbox.root))
    return {os.path.basename(r.path): r.status for r in last.collect()}


def loads(spark, inbox):
    return ledger.read_ledger(spark, inbox.root).count()


def parquet_files(inbox):
    return [
        os.path.join(base, name)
        for base, _, names in os.walk(inbox.root + "/rows")
        for name in names
        if name.endswith(".parquet")
    ]


def test_rows_arrive_typed_and_rejects_are_kept(spark, inbox):
    inbox.put("a.gz", [record("1", MW="0.1"), record("2", MW="abc"), record(None)])
    inbox.put("b.gz", [record("3")], [c for c in COLUMNS if c != "FP3"])
    last = ingest(spark, inbox.folder, inbox.root).collect()
    entries = {os.path.basename(r.path): r for r in last}
    table = read_table(spark, inbox.root)
    assert table.columns == [*COLUMNS, "src"]
    assert [(r.ID, r.MW) for r in table.collect()] == [("1", 0.10000000149011612)]
    rejected = {r.ID: r for r in read_rejects(spark, inbox.root).collect()}
    assert rejected["2"].reject_reasons == ["MW"] and rejected["2"].MW_text == "abc"
    assert rejected[None].reject_reasons == ["ID"]
    assert rejected["3"].reject_reasons == ["FP3"]
    assert (entries["a.gz"].rows_loaded, entries["a.gz"].rows_rejected) == (1, 2)
    assert (entries["b.gz"].rows_loaded, entries["b.gz"].rows_rejected) == (0, 1)
    assert entries["a.gz"].bytes == os.path.getsize(inbox.folder + "/a.gz")


def test_rejects_of_a_source_share_a_file_and_keep_their_library(spark, inbox):
    inbox.put("a.gz", [record(str(i), library=f"L{i}", MW="x") for i in range(20)])
    ingest(spark, inbox.folder, inbox.root)
    assert len(parquet_files(inbox)) == 1
    rejected = {r.ID: r.Library_ID for r in read_rejects(spark, inbox.root).collect()}
    assert rejected == {str(i): f"L{i}" for i in range(20)}


def test_a_second_run_takes_only_new_files(spark, inbox):
    inbox.put("a.gz", [record("1")])
    ingest(spark, inbox.folder, inbox.root)
    inbox.put("b.gz", [record("2")])
    ingest(spark, inbox.folder, inbox.root)
    ingest(spark, inbox.folder, inbox.root)
    assert ids(spark, inbox) == ["1", "2"] and loads(spark, inbox) == 2


def test_an_empty_inbox_and_folders_within_it(spark, inbox):
    ingest(spark, inbox.folder, inbox.root)
    assert loads(spark, inbox) == 0
    inbox.put("a.gz", [record("1")])
    inbox.put("day=1/b.gz", [record("2")])
    ingest(spark, inbox.folder, inbox.root)
    assert ids(spark, inbox) == ["1"]
    ingest(spark, inbox.folder, inbox.root, options=IngestOptions(recursive=True))
    assert ids(spark, inbox) == ["1", "2"]


def test_small_micro_batches_cover_everything(spark, inbox):
    for i in range(7):
        inbox.put(f"{i}.gz", [record(str(i))])
    ingest_stream(spark, inbox.folder, inbox.root, IngestOptions(max_files=2))
    assert ids(spark, inbox) == [str(i) for i in range(7)]
    assert ledger.read_ledger(spark, inbox.root).select("load_id").distinct().count() == 4


def test_old_files_arriving_late_are_not_ignored(spark, inbox):
    inbox.put("new.gz", [record("1")])
    ingest_stream(spark, inbox.folder, inbox.root)
    old = inbox.put("old.gz", [record("2")])
    os.utime(old, (10**9, 10**9))
    ingest_stream(spark, inbox.folder, inbox.root)
    assert ids(spark, inbox) == ["1", "2"]


@pytest.mark.parametrize("where", ["before ledger", "after ledger"])
def test_crash_and_restart_neither_lose_nor_double(spark, inbox, monkeypatch, where):
    for name in "abc":
        inbox.put(f"{name}.gz", [record(f"{name}{i}") for i in range(5)])
    options = IngestOptions(max_files=1)
    real, calls = ledger.append_entries, []

    def crash(entries, root, load_id):
        calls.append(load_id)
        if where == "after ledger":
            real(entries, root, load_id)
        if len(calls) == 2:
            raise RuntimeError("crash")
        if where == "before ledger":
            real(entries, root, load_id)

    monkeypatch.setattr(load.ledger, "append_entries", crash)
    with pytest.raises(Exception, match="crash"):
        ingest_stream(spark, inbox.folder, inbox.root, options)
    monkeypatch.setattr(load.ledger, "append_entries", real)
    ingest_stream(spark, inbox.folder, inbox.root, options)
    assert ids(spark, inbox) == sorted(f"{n}{i}" for n in "abc" for i in range(5))
    assert states(spark, inbox) == dict.fromkeys(["a.gz", "b.gz", "c.gz"], "loaded")
    assert loads(spark, inbox) == 3


def test_fresh_checkpoint_skips_or_replaces(spark, inbox, tmp_path):
    inbox.put("a.gz", [record("1"), record("2", library="L2")])
    inbox.put("b.gz", [record("3")])
    ingest_stream(spark, inbox.folder, inbox.root)
    ingest_stream(spark, inbox.folder, inbox.root, checkpoint=str(tmp_path / "c1"))
    assert loads(spark, inbox) == 2
    ingest_stream(spark, inbox.folder, inbox.root, TAKE_KNOWN, str(tmp_path / "c2"))
    assert loads(spark, inbox) == 4 and ids(spark, inbox) == ["1", "2", "3"]


def test_files_sharing_a_library_do_not_disturb_each_other(spark, inbox):
    inbox.put("a.gz", [record("1", library="S")])
    ingest(spark, inbox.folder, inbox.root)
    inbox.put("b.gz", [record("2", library="S")])
    ingest(spark, inbox.folder, inbox.root)
    ingest(spark, inbox.folder, inbox.root, options=TAKE_KNOWN)
    assert ids(spark, inbox) == ["1", "2"]


@pytest.mark.parametrize(
    "library", ["00", "007", "1e5", "a b", "a=b", "x/y", "50%", "é:*?", "2024-01-01", "NULL"]
)
def test_library_names_survive_the_partition_folders(spark, inbox, library):
    inbox.put("a.gz", [record("1", library=library)])
    ingest(spark, inbox.folder, inbox.root)
    assert read_table(spark, inbox.root).first().Library_ID == library
    assert lookup_by_id(read_table(spark, inbox.root), "1", library).count() == 1


def test_redelivered_path_is_skipped_unless_asked_for(spark, inbox):
    inbox.put("a.gz", [record("1", library="old"), record("2", library="both", MW="x")])
    ingest(spark, inbox.folder, inbox.root)
    inbox.put("a.gz", [record("3", library="both"), record("4", library="new")])
    ingest(spark, inbox.folder, inbox.root)
    assert ids(spark, inbox) == ["1"]
    ingest(spark, inbox.folder, inbox.root, options=TAKE_KNOWN)
    assert ids(spark, inbox) == ["3", "4"]
    assert read_rejects(spark, inbox.root).count() == 0
    last = ledger.latest_entries(ledger.read_ledger(spark, inbox.root)).first()
    assert (last.rows_loaded, last.rows_rejected) == (2, 0)
    assert not os.listdir(inbox.root + "/_stale")


def test_damaged_redelivery_leaves_the_old_rows(spark, inbox):
    path = inbox.put("a.gz", [record(str(i)) for i in range(500)])
    ingest(spark, inbox.folder, inbox.root)
    data = open(path, "rb").read()
    inbox.put_bytes("a.gz", data[: len(data) // 2])
    ingest(spark, inbox.folder, inbox.root, options=TAKE_KNOWN)
    assert states(spark, inbox) == {"a.gz": "quarantined"}
    assert len(ids(spark, inbox)) == 500
    entry = ledger.latest_entries(ledger.read_ledger(spark, inbox.root)).first()
    assert entry.rows_loaded == 500  # what the table holds, not what this delivery brought


@pytest.mark.parametrize("verify_first", [False, True])
def test_damaged_files_are_set_aside_whole(spark, inbox, verify_first):
    data = gzip.compress(tsv([record(f"x{i}", FP1=str(i) * 9) for i in range(3000)]).encode())
    inbox.put("good.gz", [record("1")])
    inbox.put_bytes("cut.gz", data[:-100])
    inbox.put_bytes("plain.gz", b"ID\n1\n")
    inbox.put_text("empty.gz", "")
    inbox.put("header.gz", [])
    ingest(spark, inbox.folder, inbox.root, options=IngestOptions(verify_first=verify_first))
    assert ids(spark, inbox) == ["1"]
    assert states(spark, inbox) == {
        "good.gz": "loaded",
        "header.gz": "loaded",
        "cut.gz": "quarantined",
        "plain.gz": "quarantined",
        "empty.gz": "quarantined",
    }


def test_a_failing_file_stays_pending_and_holds_nothing_back(spark, inbox, monkeypatch):
    bad = inbox.put("bad.gz", [record("1")])
    for i in range(2, 7):
        inbox.put(f"good{i}.gz", [record(str(i))])
    real = load._classified

    def refuse(session, files, options):
        if any(f.path.endswith("/bad.gz") for f in files):
            raise RuntimeError("storage is away\nlong trace")
        return real(session, files, options)

    monkeypatch.setattr(load, "_classified", refuse)
    ingest(spark, inbox.folder, inbox.root)
    assert ids(spark, inbox) == ["2", "3", "4", "5", "6"]
    assert [n for n, s in states(spark, inbox).items() if s == "failed"] == ["bad.gz"]
    reasons = ledger.read_ledger(spark, inbox.root).filter("status = 'failed'")
    assert reasons.first().reason == "storage is away"
    monkeypatch.setattr(load, "_classified", real)
    ingest(spark, inbox.folder, inbox.root)
    assert ids(spark, inbox) == ["1", "2", "3", "4", "5", "6"] and os.path.exists(bad)


def test_listed_files_are_ingested_once_and_missing_ones_later(spark, inbox, tmp_path):
    outside = tmp_path / "else.tsv"
    outside.write_text(tsv([record("9")]))
    absent = str(tmp_path / "later.gz")
    a = inbox.put("a.gz", [record("1")])
    listed = [str(outside), a, a, absent]
    ingest(spark, inbox.folder, inbox.root, listed=listed)
    assert ids(spark, inbox) == ["1", "9"]
    assert states(spark, inbox)["later.gz"] == "failed"
    with open(absent, "wb") as file:
        file.write(gzip.compress(tsv([record("5")]).encode()))
    ingest(spark, inbox.folder, inbox.root)
    assert ids(spark, inbox) == ["1", "5", "9"]


def test_placeholder_without_bytes_is_loaded_once_it_has_content(spark, inbox):
    inbox.put_bytes("a.gz", b"")
    inbox.put("b.gz", [record("1")])
    ingest(spark, inbox.folder, inbox.root)
    assert states(spark, inbox) == {"b.gz": "loaded"}
    inbox.put("a.gz", [record("2")])
    ingest(spark, inbox.folder, inbox.root)
    assert ids(spark, inbox) == ["1", "2"]


def test_row_count_mismatch_is_an_error_not_a_load(spark, inbox, monkeypatch):
    inbox.put("a.gz", [record("1")])
    monkeypatch.setattr(load.table, "append_rows", lambda rows, root, replace=False: rows.count())
    ingest(spark, inbox.folder, inbox.root)
    assert states(spark, inbox) == {"a.gz": "failed"}


def test_an_unwritable_table_ends_the_load_and_blames_no_file(spark, inbox, monkeypatch):
    for name in "abc":
        inbox.put(f"{name}.gz", [record(name)])
    attempts, real = [], load.table.append_rows

    def refuse(rows, root, replace=False):
        attempts.append(root)
        real(rows, "/proc/no-such-folder", replace)

    monkeypatch.setattr(load.table, "append_rows", refuse)
    with pytest.raises(Exception):
        ingest(spark, inbox.folder, inbox.root)
    assert len(attempts) == 1 and loads(spark, inbox) == 0
    monkeypatch.setattr(load.table, "append_rows", real)
    ingest(spark, inbox.folder, inbox.root)
    assert ids(spark, inbox) == ["a", "b", "c"]


def test_one_cut_file_among_many_costs_one_repeat(spark, inbox, monkeypatch):
    data = gzip.compress(tsv([record(f"x{i}", FP1=str(i) * 9) for i in range(30_000)]).encode())
    inbox.put_bytes("cut.gz", data[:-100])
    for i in range(49):
        inbox.put(f"{i:02d}.gz", [record(str(i))])
    writes, real = [], load._write
    monkeypatch.setattr(load, "_write", lambda *a: writes.append(len(a[1])) or real(*a))
    ingest(spark, inbox.folder, inbox.root)
    assert writes == [50, 49] and len(ids(spark, inbox)) == 49
    assert states(spark, inbox)["cut.gz"] == "quarantined"


def test_partitions_hold_for_small_sources(spark, inbox):
    inbox.put("a.gz", [record(f"i{i:03d}") for i in range(400)])
    ingest(spark, inbox.folder, inbox.root, options=IngestOptions(partitions=4))
    assert len(parquet_files(inbox)) == 4
    assert IngestOptions(partitions=4).ranges(1) == 4
    assert IngestOptions(file_bytes=10).ranges(35) == 4 and IngestOptions().ranges(0) == 1


def test_cleanup_removes_only_unchanged_loaded_sources(spark, inbox):
    inbox.put("loaded.gz", [record("1")])
    inbox.put_bytes("plain.gz", b"ID\n1\n")
    inbox.put("changed.gz", [record("2")])
    ingest(spark, inbox.folder, inbox.root)
    inbox.put("changed.gz", [record("2"), record("3")])
    inbox.put("unknown.gz", [record("4")])
    assert delete_loaded(discover_files(spark, inbox.folder), inbox.root) == 1
    assert sorted(os.listdir(inbox.folder)) == ["changed.gz", "plain.gz", "unknown.gz"]
    assert ids(spark, inbox) == ["1", "2"]


def test_cleanup_keeps_a_source_replaced_by_one_of_equal_length(spark, inbox):
    path = inbox.put("a.gz", [record("1")])
    ingest(spark, inbox.folder, inbox.root)
    inbox.put("a.gz", [record("1")])
    os.utime(path, ns=(0, os.stat(path).st_mtime_ns - 5_000_000_000))
    assert delete_loaded(discover_files(spark, inbox.folder), inbox.root) == 0
    assert os.path.exists(path)


def test_a_row_with_too_many_fields_is_rejected_with_its_line(spark, inbox):
    values = list(record("2").values())
    long_line = "\t".join([*values, "more"])
    quoted = "\t".join(["3", *values[1:11], '"a\tb"'])
    text = tsv([record("1")]) + long_line + "\n" + quoted + "\n" + "\t".join(values[:10]) + "\n"
    inbox.put_text("a.gz", text)
    ingest(spark, inbox.folder, inbox.root)
    assert ids(spark, inbox) == ["1", "2", "3"]
    row = read_rejects(spark, inbox.root).first()
    assert (row.reject_reasons, row.corrupt_record) == (["FIELD_COUNT"], long_line)


@pytest.mark.parametrize("name", ["L" * 300, "__HIVE_DEFAULT_PARTITION__", ":" * 90])
def test_a_library_that_cannot_be_a_folder_costs_its_rows_only(spark, inbox, name):
    inbox.put("a.gz", [record("1"), record("2", library=name)])
    ingest(spark, inbox.folder, inbox.root)
    assert ids(spark, inbox) == ["1"]
    row = read_rejects(spark, inbox.root).first()
    assert (row.Library_ID, row.reject_reasons) == (name, ["LIBRARY_NAME"])


def test_a_name_that_points_elsewhere_is_not_taken(spark, inbox, tmp_path):
    register_table(spark, "lakeload_elsewhere", str(tmp_path / "other"))
    with pytest.raises(ValueError, match="not the table"):
        register_table(spark, "lakeload_elsewhere", inbox.root)
    spark.sql("DROP TABLE lakeload_elsewhere")


def test_headers_of_many_widths_take_several_writes(spark, inbox):
    rng = random.Random(1)
    for i in range(6):
        header = [*COLUMNS, *(f"x{n}" for n in range(i // 2))]
        rng.shuffle(header)
        inbox.put(f"{i}.gz", [{**record(str(i)), **{n: "?" for n in header if n not in COLUMNS}}], header)
    ingest(spark, inbox.folder, inbox.root, options=IngestOptions(scans_per_write=2))
    assert ids(spark, inbox) == [str(i) for i in range(6)]


def test_five_hundred_headers_take_one_scan_and_one_write(spark, inbox, monkeypatch):
    rng, orders = random.Random(2), set()
    while len(orders) < 500:
        orders.add(tuple(rng.sample(COLUMNS[:8], 8) + rng.sample([*COLUMNS[8:11], "Extra"], 4)))
    for i, header in enumerate(sorted(orders)):
        values = {**record(f"{i:03d}", MW=str(i), FP3=f"three{i}"), "Extra": "no"}
        inbox.put(f"{i:03d}.gz", [values], header)
    plans, append = [], table.append_rows

    def noted(rows, *args, **kwargs):
        plans.append(rows.select("*")._jdf.queryExecution().executedPlan().toString())
        append(rows, *args, **kwargs)

    monkeypatch.setattr(table, "append_rows", noted)
    ingest(spark, inbox.folder, inbox.root)
    (plan,) = plans
    assert plan.count("FileScan csv") == 1 and "hashpartitioning" not in plan
    rows = read_table(spark, inbox.root).collect()
    assert sorted((r.ID, r.MW, r.FP3) for r in rows) == [(f"{i:03d}", float(i), f"three{i}") for i in range(500)]
    assert {r.FP5 for r in rows} == {None}
    entries = ledger.read_ledger(spark, inbox.root).collect()
    assert len(entries) == 500 and all(r.extra_columns == ["Extra"] for r in entries)


class Throwable:
    """What a Java error tells."""

    def __init__(self, kind, condition=None, text="", cause=None):
        self.kind, self.condition, self.text, self.cause = kind, condition, text, cause

    def getClass(self):
        return self

    def getSimpleName(self):
        return self.kind

    def getCondition(self):
        if self.condition is None:
            raise TypeError("'JavaMember' object is not callable")
        return self.condition

    def getSqlState(self):
        return "KD001" if self.condition else self.getCondition()

    def toString(self):
        return f"{self.kind}: {self.text}"

    def getCause(self):
        return self.cause


@pytest.mark.parametrize(
    "chain, systemic",
    [
        ([("SparkException", None, "Job aborted"), ("SparkException", "FAILED_READ_FILE.NO_HINT", ""), ("EOFException", None, "")], False),
        ([("AnalysisException", "PATH_NOT_FOUND", "")], False),
        ([("SparkException", None, "Job aborted"), ("IOException", None, "No space left on device")], True),
        ([("SparkException", None, "a file named FAILED_READ_FILE"), ("IOException", None, "PATH_NOT_FOUND")], True),
        ([("SparkException", "FAILED_READ_FILE.NO_HINT", ""), ("AccessControlException", None, "no")], True),
        ([("SparkException", "FAILED_READ_FILE.NO_HINT", ""), ("FileNotFoundException", None, "/a (Permission denied)")], True),
        ([("SparkException", "FAILED_READ_FILE.FILE_NOT_EXIST", ""), ("FileNotFoundException", None, "/a (No such file)")], False),
        ([], False),
    ],
)
def test_errors_are_told_apart_by_condition(chain, systemic):
    throwable = None
    for kind, condition, text in reversed(chain):
        throwable = Throwable(kind, condition, text, throwable)
    error = RuntimeError("own text")
    error.java_exception = throwable
    assert load._is_systemic(error) == systemic
    line = load._first_line(error)
    assert line.endswith(f"{chain[-1][0]}: {chain[-1][2]}".strip() if chain else "own text")
    conditions = [c for _, c, _ in chain if c]
    assert line.startswith(f"[{conditions[-1]} KD001]") if conditions else not line.startswith("[")


def test_lost_read_permission_ends_the_load_after_one_attempt(spark, inbox, monkeypatch):
    for name in "abcd":
        inbox.put(f"{name}.gz", [record(name)])
    attempts = []

    def refuse(rows, root, replace=False):
        attempts.append(root)
        error = RuntimeError("refused")
        denied = Throwable("AccessControlException", None, "Permission denied")
        error.java_exception = Throwable("SparkException", "FAILED_READ_FILE.NO_HINT", "", denied)
        raise error

    with monkeypatch.context() as patched:
        patched.setattr(table, "append_rows", refuse)
        with pytest.raises(Exception, match="refused"):  # noqa: B017
            ingest(spark, inbox.folder, inbox.root)
    assert len(attempts) == 1 and loads(spark, inbox) == 0
    ingest(spark, inbox.folder, inbox.root)
    assert ids(spark, inbox) == list("abcd")


def test_rounds_of_a_batch_run(spark, inbox):
    for i in range(5):
        inbox.put(f"{i}.gz", [record(str(i))])
    files = discover_files(spark, inbox.folder)
    ingest_files(files.unionByName(files), inbox.root, IngestOptions(max_files=2))
    assert ids(spark, inbox) == [str(i) for i in range(5)]
    assert ledger.read_ledger(spark, inbox.root).select("load_id").distinct().count() == 3


# Layout


def test_small_sources_are_written_without_a_shuffle_and_with_one_sort(spark, inbox, monkeypatch):
    written = []
    append = table.append_rows

    def noted(rows, *args, **kwargs):
        written.append(rows.select("*")._jdf.queryExecution().executedPlan())
        append(rows, *args, **kwargs)

    monkeypatch.setattr(table, "append_rows", noted)
    for name in "ab":
        inbox.put(f"{name}.gz", [record(f"{name}{i}") for i in range(100)])
    ingest(spark, inbox.folder, inbox.root)
    (plan,) = written
    tree = plan.toString()
    assert "Exchange" not in tree and tree.count("Sort ") == 1 and tree.count("FileScan csv") == 1
    # The order that the writer asks for, on columns that are not nullable: it adds no sort of its own.
    order = plan.outputOrdering()
    keys = [order.apply(i).child() for i in range(3)]
    assert [(k.name(), k.nullable()) for k in keys] == [(c, False) for c in PARTITION_COLUMNS]


def test_split_source_with_a_hot_id(spark, inbox):
    rows = [record("HOT" if i % 3 == 0 else f"i{i:05d}", FP4=str(i)) for i in range(6000)]
    random.Random(0).shuffle(rows)
    inbox.put("a.gz", rows)
    ingest(spark, inbox.folder, inbox.root, options=IngestOptions(partitions=8))
    sizes = (
        read_table(spark, inbox.root)
        .groupBy(F.col("_metadata.file_path").alias("file"))
        .agg(F.count("ID").alias("n"), F.min("ID").alias("low"), F.max("ID").alias("high"))
        .collect()
    )
    parts = sorted(sizes, key=lambda r: (r.low, r.high))
    assert sum(r.n for r in parts) == 6000 and len(parts) >= 6
    assert max(r.n for r in parts) < 2 * 6000 / 8
    assert all(a.high <= b.low for a, b in zip(parts, parts[1:]))
    assert lookup_by_id(read_table(spark, inbox.root), "HOT").count() == 2000
    assert read_table(spark, inbox.root).select("FP4").distinct().count() == 6000
    assert not os.listdir(inbox.root + "/_staging")


def test_rows_are_ordered_by_id_within_a_file(spark, inbox):
    rows = [record(f"i{i:04d}") for i in range(500)]
    random.Random(0).shuffle(rows)
    inbox.put("a.gz", rows)
    ingest(spark, inbox.folder, inbox.root)
    (path,) = parquet_files(inbox)
    stored = [r.ID for r in spark.read.parquet(path).select("ID").collect()]
    assert stored == sorted(stored) and len(stored) == 500


def test_lookup_prunes_partitions_and_pushes_the_id(spark, inbox):
    inbox.put("a.gz", [record("1", library="A"), record("1", library="B"), record("2")])
    ingest(spark, inbox.folder, inbox.root)
    hits = lookup_by_id(read_table(spark, inbox.root), "1", "A")
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(ID,1)" in plan
    partition_filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "Library_ID" in partition_filters
    assert hits.columns == list(COLUMNS) and hits.count() == 1
    assert lookup_by_id(read_table(spark, inbox.root), "1").count() == 2
    assert lookup_by_id(read_table(spark, inbox.root), "' OR '1'='1").count() == 0


def test_preview_reads_three_columns(spark, inbox):
    inbox.put("a.gz", [record(str(i)) for i in range(9)])
    ingest(spark, inbox.folder, inbox.root)
    top = preview(read_table(spark, inbox.root))
    assert [r.ID for r in top.collect()] == ["0", "1", "2", "3"]
    schema = top._jdf.queryExecution().executedPlan().toString().split("ReadSchema: ")[1]
    assert "FP1" not in schema and "Sub_ID_3" in schema


def test_bloom_filter_and_small_pages_are_written(spark, inbox):
    import pyarrow.parquet as pq

    inbox.put("a.gz", [record(f"i{i:05d}", FP1=str(i) * 50) for i in range(5000)])
    ingest(spark, inbox.folder, inbox.root)
    (path,) = parquet_files(inbox)
    columns = {
        c.path_in_schema: c
        for c in (pq.ParquetFile(path).metadata.row_group(0).column(i) for i in range(11))
    }
    assert columns["ID"].compression == "ZSTD"
    assert columns["ID"].has_column_index and columns["ID"].has_offset_index
    assert "PLAIN_DICTIONARY" not in columns["FP1"].encodings
    assert "RLE_DICTIONARY" not in columns["FP1"].encodings


def rows_scanned(df):
    """Rows the table scan of an executed query handed on."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    while not plan.nodeName().startswith("Scan "):
        plan = plan.children().head()
    return plan.metrics().apply("numOutputRows").value()


def test_lookup_reads_a_page_not_the_file(spark, inbox):
    ordered = [record(f"i{i:05d}", FP1=str(i) * 50) for i in range(20_000)]
    random.Random(0).shuffle(ordered)
    inbox.put("a.gz", ordered)
    ingest(spark, inbox.folder, inbox.root)
    table = read_table(spark, inbox.root)
    assert rows_scanned(lookup_by_id(table, "i04711")) <= 1024
    # Within the range of IDs, but not there: the bloom filter drops the row group.
    assert rows_scanned(lookup_by_id(table, "i04711x")) == 0


def test_table_under_a_catalog_name(spark, inbox):
    inbox.put("a.gz", [record("1", library="00")])
    ingest(spark, inbox.folder, inbox.root)
    register_table(spark, "lakeload_named", inbox.root)
    register_table(spark, "lakeload_named", inbox.root)
    row = spark.sql("SELECT * FROM lakeload_named WHERE ID = :id", args={"id": "1"}).first()
    assert (row.Library_ID, row.MW) == ("00", 1.5)
    assert row.src == source_key(qualify(spark, inbox.folder + "/a.gz"))
    spark.sql("DROP TABLE lakeload_named")


def test_empty_table_is_readable(spark, inbox):
    ingest_module.prepare(spark, inbox.root)
    assert read_table(spark, inbox.root).count() == 0
    assert read_rejects(spark, inbox.root).count() == 0
    assert lookup_by_id(read_table(spark, inbox.root), "x").collect() == []


def test_staging_level_accepts_rows_with_nulls(spark, inbox):
    inbox.put("a.gz", [record("1", MW="abc", library=None), record(None)])
    options = replace(IngestOptions(), level="staging")
    ingest(spark, inbox.folder, inbox.root, options=options)
    (row,) = read_table(spark, inbox.root).collect()
    assert (row.ID, row.Library_ID, row.MW) == ("1", None, None)


def test_listed_files_elsewhere_are_cleaned_up_too(spark, inbox, tmp_path):
    elsewhere = tmp_path / "else.gz"
    elsewhere.write_bytes(gzip.compress(tsv([record("9")]).encode()))
    inbox.put("a.gz", [record("1")])
    absent = str(tmp_path / "absent.gz")
    ingest(spark, inbox.folder, inbox.root, listed=[str(elsewhere), absent], delete_consumed=True)
    assert ids(spark, inbox) == ["1", "9"]
    assert not elsewhere.exists() and os.listdir(inbox.folder) == []
