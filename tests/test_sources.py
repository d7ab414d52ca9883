"""Discovery, header probes, scans, sinks, damaged files and the ledger."""

import gzip
import itertools
import os
import random
from types import SimpleNamespace

import pytest
from conftest import record, tsv
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lakeload.functions.paths import glob_escape, normalize, qualify, scratch_dir
from lakeload.functions.schema import COLUMNS
from lakeload.operators.generate import sample_records
from lakeload.sources.discovery import combine_files, discover_files, in_order, listed_files
from lakeload.sources.files import note_paths, path_frame, remove_noted, resolve
from lakeload.sources.ledger import (
    ENTRY_SCHEMA,
    append_entries,
    create_ledger,
    latest_entries,
    pending_files,
    read_ledger,
)
from lakeload.sources.probe import probe_headers, verify_files
from lakeload.sources.tsv import column_names, scan_files, write_tsv


def names(files):
    return [os.path.basename(r.path) for r in in_order(files).collect()]


def scan(spark, paths):
    return scan_files(path_frame(spark, [qualify(spark, p) for p in paths]))


# Discovery


def test_discovery_is_flat_by_default_and_honours_the_extension(spark, inbox):
    inbox.put("a.tsv.gz", [record("1")])
    inbox.put("b.csv.gz", [record("2")])
    inbox.put("sub/c.tsv.gz", [record("3")])
    inbox.put("day=1/e.csv.gz", [record("4")])
    inbox.put("part=1/f.csv.gz", [record("5")])
    inbox.put_bytes("d.tsv", b"plain")
    found = discover_files(spark, inbox.folder).withColumn("position", F.lit(None))
    assert names(found) == ["a.tsv.gz", "b.csv.gz"]
    only_tsv = discover_files(spark, inbox.folder, ".tsv.gz", recursive=True)
    paths = sorted(r.path for r in only_tsv.collect())
    assert [p.removeprefix("file:" + inbox.folder) for p in paths] == [
        "/a.tsv.gz",
        "/sub/c.tsv.gz",
    ]


def test_listed_files_come_first_and_once(spark, inbox):
    a, b, c = (inbox.put(f"{n}.gz", [record(n)]) for n in "abc")
    listed = listed_files(spark, [c, "file://" + c, a, c])
    files = combine_files(listed, discover_files(spark, inbox.folder))
    assert names(files) == ["c.gz", "a.gz", "b.gz"]


@pytest.mark.parametrize(
    "name", ["with space.gz", "x[1]{2}*?.gz", "a+b%2F.gz", "=é#&.gz"]
)
def test_odd_file_names_survive_discovery_and_scan(spark, inbox, name):
    inbox.put(name, [record("1"), record("2")])
    inbox.put("x.gz", [record("3")])
    found = discover_files(spark, inbox.folder).filter(~F.col("path").endswith("/x.gz"))
    rows = scan_files(found).collect()
    assert [r.ID for r in rows] == ["1", "2"]
    assert {r.source_path for r in rows} == {"file:" + os.path.join(inbox.folder, name)}


def test_an_empty_folder_holds_no_files(spark, inbox):
    assert discover_files(spark, inbox.folder).collect() == []


def test_paths_have_one_spelling(spark):
    assert normalize("file:///a/b") == normalize("file:/a/b") == "file:/a/b"
    assert qualify(spark, "/a/b") == qualify(spark, "file:///a/b")
    assert glob_escape("a*[b]") == "a\\*\\[b\\]"
    fs, inside = resolve("file:/a b/%41")
    assert inside == "/a b/%41"


def test_scratch_is_under_the_shared_checkpoint_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir", None)
    path = scratch_dir(spark, "t")
    if shared:
        assert path.startswith(qualify(spark, shared) + "/lakeload-t-")
    assert path != scratch_dir(spark, "t")


@pytest.mark.parametrize("master", ["local[8]", "yarn"])
def test_scratch_without_a_shared_folder(spark, master):
    session = SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: default),
        sparkContext=SimpleNamespace(master=master),
        _jvm=spark._jvm,
        _jsc=spark._jsc,
    )
    if master == "yarn":
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            scratch_dir(session, "t")
    else:
        assert "/lakeload-t-" in scratch_dir(session, "t")


# Scan


@pytest.mark.parametrize("seed", range(4))
def test_any_order_of_the_headers_gives_the_same_rows(spark, inbox, seed):
    header = list(COLUMNS)
    random.Random(seed).shuffle(header)
    rows = [record(f"r{i}", FP4=None if i % 2 else f"v{i}") for i in range(5)]
    canonical = inbox.put("canonical.gz", rows)
    shuffled = inbox.put("shuffled.gz", rows, header)
    for path in (canonical, shuffled):
        got = scan(spark, [path]).select(*COLUMNS).orderBy("ID").collect()
        assert [r.asDict() for r in got] == rows


def test_mixed_headers_in_one_set(spark, inbox):
    lacking = [c for c in COLUMNS if c != "FP3"]
    inbox.put("a.gz", [record("a")])
    inbox.put("b.gz", [record("b")], list(reversed(COLUMNS)))
    inbox.put("c.gz", [{**record("c"), "extra": "e"}], [*lacking, "extra"])
    rows = {r.ID: r for r in scan_files(discover_files(spark, inbox.folder)).collect()}
    assert [rows[k].FP3 for k in "abc"] == ["3,3", "3,3", None]
    assert [rows[k].FP4 for k in "abc"] == ["4,4", "4,4", "4,4"]


def test_text_dialect(spark, inbox):
    header = "ID\tFP1\tSub_ID_1"
    path = inbox.put_text(
        "a.gz", "﻿" + f'{header}\r\n1\t"x\ty"\tz\r\n\r\n2\t1,2\t\r\n'
    )
    rows = scan(spark, [path]).orderBy("ID").collect()
    assert [(r.ID, r.FP1, r.Sub_ID_1) for r in rows] == [("1", "x\ty", "z"), ("2", "1,2", None)]


@pytest.mark.parametrize(
    "line",
    ['"ID"\t"a\tb"\tMW', 'a"b\tc\td', '"x\\"y"\tz', " ID \tMW", "ID\t\tMW", "\tID", '"ID\tMW'],
)
def test_headers_are_read_as_the_scan_would(spark, inbox, line):
    path = inbox.put_text("a.gz", line + "\n1\t2\t3\n")
    spark_names = spark.read.option("sep", "\t").option("header", True).csv(path).columns
    probed = probe_headers(path_frame(spark, [path])).first()
    assert column_names(probed.header) == spark_names


def test_blank_lines_ahead_of_the_header(spark, inbox):
    path = inbox.put_text("a.gz", "\n  \n" + tsv([record("1")]))
    assert [r.ID for r in scan(spark, [path]).collect()] == ["1"]


def test_short_and_long_rows_keep_their_raw_line(spark, inbox):
    path = inbox.put_text("a.gz", "ID\tFP1\tFP2\n1\tx\n2\tx\ty\tz\n3\tx\ty\n")
    rows = {r.ID: r for r in scan(spark, [path]).collect()}
    assert (rows["1"].FP1, rows["1"].FP2, rows["1"].corrupt_record) == ("x", None, "1\tx")
    assert (rows["2"].FP2, rows["2"].corrupt_record) == ("y", "2\tx\ty\tz")
    assert rows["3"].corrupt_record is None


def test_concatenated_gzip_members_are_one_file(spark, inbox):
    text = tsv([record("1"), record("2")]).encode()
    path = inbox.put_bytes("a.gz", gzip.compress(text[:150]) + gzip.compress(text[150:]))
    assert scan(spark, [path]).count() == 2
    assert verify_files(path_frame(spark, [path])).first().reason is None


def test_one_task_per_large_set_of_files_not_per_header(spark, inbox):
    for i in range(6):
        inbox.put(f"{i}.gz", [record(str(i))])
    plan = scan_files(discover_files(spark, inbox.folder))._jdf.queryExecution()
    assert plan.executedPlan().toString().count("FileScan csv") == 1


# Probe and verification


def test_probe_tells_usable_empty_and_broken_files_apart(spark, inbox):
    inbox.put("good.gz", [record("1")])
    inbox.put_text("header_only.gz", "\t".join(COLUMNS) + "\n")
    inbox.put_text("no_newline.gz", "ID\tFP1")
    inbox.put_text("empty_gzip.gz", "")
    inbox.put_bytes("zero.gz", b"")
    inbox.put_text("long.gz", "x" * 200_000 + "\n")
    inbox.put("_hidden.gz", [record("1")])
    inbox.put_bytes("not_gzip.gz", b"ID\tLibrary_ID\n1\t2\n")
    files = discover_files(spark, inbox.folder).unionByName(
        # Spark lists no files without bytes; such a one can only be named.
        path_frame(spark, [f"file:{inbox.folder}/{n}.gz" for n in ("absent", "zero", "_hidden")]),
        allowMissingColumns=True,
    )
    probed = {os.path.basename(r.path): r for r in probe_headers(files).collect()}
    assert probed["good.gz"].header == list(COLUMNS) and probed["good.gz"].status is None
    assert probed["header_only.gz"].status is None
    assert probed["no_newline.gz"].header == ["ID", "FP1"]
    assert probed["empty_gzip.gz"].reason == probed["zero.gz"].reason == "NO_HEADER"
    assert probed["not_gzip.gz"].status == "quarantined"
    assert probed["long.gz"].status == "quarantined"
    assert probed["absent.gz"].status == "failed"
    assert probed["_hidden.gz"].reason == "HIDDEN_NAME"


@pytest.mark.parametrize("cut", [1, 4, 8, 9, 20, 500])
def test_a_cut_file_raises_whatever_the_session_says(spark, inbox, cut):
    rows = [record(f"r{i}", FP1=str(random.Random(i).random())) for i in range(2000)]
    data = gzip.compress(tsv(rows).encode())
    path = inbox.put_bytes("a.gz", data[:-cut])
    assert "EOFError" in verify_files(path_frame(spark, [path])).first().reason
    spark.conf.set("spark.sql.files.ignoreCorruptFiles", "true")
    try:
        with pytest.raises((PySparkException, Py4JJavaError)):
            scan(spark, [path]).count()
    finally:
        spark.conf.unset("spark.sql.files.ignoreCorruptFiles")


def test_flipped_bytes_are_found(spark, inbox):
    data = bytearray(gzip.compress(tsv([record(str(i)) for i in range(500)]).encode()))
    data[len(data) // 2] ^= 0xFF
    path = inbox.put_bytes("a.gz", bytes(data))
    assert verify_files(path_frame(spark, [path])).first().reason is not None


# Sink


def test_sink_writes_bounded_gzip_files_with_headers(spark, inbox):
    rows = sample_records(spark, {"a.gz": 1000, "b.gz": 500}, fingerprint_length=3)
    folder = inbox.root
    write_tsv(rows, folder, partition_by="file_name", max_records_per_file=200)
    files = [
        os.path.join(base, name)
        for base, _, found in os.walk(folder)
        for name in found
        if name.endswith(".tsv.gz")
    ]
    sizes = []
    for path in files:
        with gzip.open(path, "rt") as file:
            lines = file.read().splitlines()
        assert lines[0].split("\t") == list(COLUMNS)
        sizes.append(len(lines) - 1)
    assert sum(sizes) == 1500 and max(sizes) <= 200
    back = scan_files(discover_files(spark, folder, ".tsv.gz", recursive=True))
    written = rows.select(*[F.col(c).cast("string") for c in COLUMNS])
    assert back.select(*COLUMNS).exceptAll(written).count() == 0


# Ledger


def entries(spark, *states):
    at = spark.sql("SELECT now()").first()[0]
    rows = [(p, p, s, None, 1, 1, 0, 0, [], at) for p, s in states]
    return spark.createDataFrame(rows, ENTRY_SCHEMA)


def test_only_loaded_and_quarantined_files_are_consumed(spark, inbox):
    create_ledger(spark, inbox.root)
    create_ledger(spark, inbox.root)
    files = path_frame(spark, list("abcd"))
    assert pending_files(files, read_ledger(spark, inbox.root)).count() == 4
    root = qualify(spark, inbox.root)
    append_entries(
        entries(spark, ("a", "loaded"), ("b", "quarantined"), ("c", "failed")), root, "l1"
    )
    ledger = read_ledger(spark, inbox.root)
    assert sorted(r.path for r in pending_files(files, ledger).collect()) == ["c", "d"]
    assert pending_files(files, ledger, ignore_duplicates=False).count() == 4


def test_repeating_a_load_replaces_its_entries_only(spark, inbox):
    create_ledger(spark, inbox.root)
    root = qualify(spark, inbox.root)
    append_entries(entries(spark, ("a", "failed")), root, "l1")
    append_entries(entries(spark, ("b", "loaded")), root, "l2")
    append_entries(entries(spark, ("a", "loaded")), root, "l1")
    assert read_ledger(spark, inbox.root).count() == 2
    append_entries(entries(spark, ("a", "quarantined")), root, "l3")
    last = {r.path: r.status for r in latest_entries(read_ledger(spark, inbox.root)).collect()}
    assert last == {"a": "quarantined", "b": "loaded"}


def test_removing_files_twice_is_harmless(spark, inbox):
    files = path_frame(spark, [inbox.put(f"{i}.gz", [record("1")]) for i in range(3)])
    for _ in range(2):
        note_paths(files, inbox.root + "/note")
        assert remove_noted(spark, inbox.root + "/note") == 3
        assert os.listdir(inbox.folder) == [] and os.listdir(inbox.root) == []


def test_a_file_that_goes_away_is_no_longer_listed(spark, inbox):
    inbox.put("a.gz", [record("1")])
    gone = inbox.put("b.gz", [record("2")])
    found = discover_files(spark, inbox.folder).withColumn("position", F.lit(None))
    os.remove(gone)
    assert names(found) == ["a.gz"]


def test_all_permutations_of_three_columns(spark, inbox):
    for order in itertools.permutations(["ID", "MW", "FP1"]):
        inbox.put("-".join(order) + ".gz", [record("-".join(order))], order)
    rows = scan_files(discover_files(spark, inbox.folder)).collect()
    assert len(rows) == 6
    assert {(r.MW, r.FP1, r.FP2) for r in rows} == {("1.5", "1,1", None)}
