"""Alignment, casts, validation, hashing, generation and layout operators."""

import hashlib
import math
import string

import pyarrow as pa
import pytest
from conftest import record
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeload.functions.hashing import ALPHABET, _vectors, digest, int_vector, random_key, uniform
from lakeload.functions.schema import COLUMNS, REQUIRED, TABLE_SCHEMA
from lakeload.operators.align import (
    align_columns,
    cast_measures,
    extra_columns,
    matched_columns,
)
from lakeload.operators.generate import generate_records, sample_records, task_count
from lakeload.operators.layout import cluster_across, cluster_within, spread
from lakeload.operators.validate import classify_rows
from lakeload.sources.tsv import column_names


def frame(spark, rows, columns=COLUMNS):
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], schema)


def test_canonical_schema_has_twelve_columns_and_double_measures():
    assert len(COLUMNS) == 12
    doubles = [f.name for f in TABLE_SCHEMA if f.dataType.simpleString() == "double"]
    assert doubles == ["MW", "LogP"]
    assert set(COLUMNS) - set(REQUIRED["table"]) == {"Sub_ID_3", "FP4", "FP5"}


def test_missing_column_is_null_and_neighbours_keep_their_values(spark):
    columns = [c for c in COLUMNS if c != "FP3"]
    row = align_columns(frame(spark, [record("a")], columns)).first()
    assert (row.FP2, row.FP3, row.FP4) == ("2,2", None, "4,4")


def test_extra_columns_are_dropped_and_reported(spark):
    columns = ["note", *COLUMNS, "we.ird `name"]
    assert extra_columns(columns) == ["note", "we.ird `name"]
    quoted = spark.createDataFrame([tuple("x" for _ in columns)]).toDF(*columns)
    assert align_columns(quoted).columns == list(COLUMNS)


def test_names_match_without_regard_to_case_but_not_when_ambiguous(spark):
    assert extra_columns(["id", "mw", "FP1", "fp1"]) == ["FP1", "fp1"]
    row = align_columns(spark.createDataFrame([("a", "1.5")], "id string, mw string")).first()
    assert (row.ID, row.MW) == ("a", "1.5")


def test_blank_repeated_and_reserved_headers_become_positional():
    assert column_names(["ID", "", "x", "X", "source_path"]) == ["ID", "_c1", "_c2", "_c3", "_c4"]


@pytest.mark.parametrize(
    "text, expected",
    [("1.5", 1.5), (" 1.5", 1.5), ("abc", None), (None, None), ("0.1", 0.10000000149011612)],
)
def test_measure_cast(spark, text, expected):
    rows = cast_measures(frame(spark, [record("a", MW=text)]))
    assert rows.select(F.col("MW").cast("double")).first()[0] == expected


def test_nan_text_is_a_number(spark):
    row = classify_rows(frame(spark, [record("a", MW="NaN")])).first()
    assert math.isnan(row.MW) and row.verdict == "loaded"


def test_table_level_names_every_missing_required_column(spark):
    rows = [
        record("ok", Sub_ID_3=None, FP4=None, FP5=None),
        record(None, MW="abc", FP2=None),
        record("x", library="", LogP=None),
    ]
    found = {r.ID: r for r in classify_rows(frame(spark, rows)).collect()}
    assert found["ok"].verdict == "loaded" and found["ok"].reject_reasons is None
    assert found["ok"].MW_text is None
    assert found[None].reject_reasons == ["ID", "MW", "FP2"]
    assert (found[None].verdict, found[None].MW_text) == ("rejected", "abc")
    assert found["x"].reject_reasons == ["Library_ID", "LogP"]


def test_staging_level_requires_only_the_id(spark):
    rows = [record("a", MW="abc", FP1=None), record(None)]
    found = classify_rows(frame(spark, rows), level="staging").collect()
    assert [r.verdict for r in found] == ["loaded", "rejected"]


def test_int_vector_is_long_bounded_and_roughly_uniform(spark):
    ids = spark.range(200).select(int_vector(digest("t", F.col("id")), 2048).alias("v"))
    values = [[int(x) for x in r.v.split(",")] for r in ids.collect()]
    assert {len(v) for v in values} == {2048}
    flat = [x for v in values for x in v]
    assert min(flat) == 0 and max(flat) == 1000
    assert abs(sum(flat) / len(flat) - 500) < 3
    counts = [flat.count(x) for x in (0, 1, 500, 999, 1000)]
    assert all(abs(c - len(flat) / 1001) < 0.25 * len(flat) / 1001 for c in counts)
    assert len({tuple(v) for v in values}) == 200


def test_vectors_of_any_seed_leave_a_task_in_small_batches(spark):
    # The least and the largest start and step, some between, and rows without a digest.
    seeds = [0, 2**20 - 1, (2**28 - 1) << 20, 2**48 - 1, None, None]
    seeds += [(i * 7919**4) % 2**48 if i % 3 else None for i in range(1000)]

    def plain(seed):
        if seed is None:
            return None
        points = [(seed >> 20) + (seed % 2**20 + 1) * i for i in range(2048)]
        return ",".join(str(x * x % 2147483647 % 1001) for x in points)

    empty = pa.nulls(len(seeds), pa.int64())
    vectors = _vectors(["A", "B"], 2048).func
    batches = list(vectors(iter([(pa.array(seeds), empty), (pa.array(seeds[:1]), empty[:1])])))
    assert max(map(len, batches)) <= 64
    rows = [row for batch in batches for row in batch.to_pylist()]
    assert [row["A"] for row in rows] == [plain(seed) for seed in [*seeds, seeds[0]]]
    assert {row["B"] for row in rows} == {None}


def test_all_vectors_of_a_record_are_made_by_one_function(spark):
    ids = spark.range(10).withColumn("file_name", F.lit("f"))
    made = generate_records(ids, fingerprint_length=4)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("vectors(") == plan.count("ArrowEvalPython") == 1
    for row in made.collect():
        assert all(len(row[name].split(",")) == 4 for name in ("FP1", "FP2", "FP3"))


def test_a_key_is_made_of_three_hex_digits_a_character(spark):
    hexes = [hashlib.md5(str(i).encode()).hexdigest() for i in range(500)] + ["f" * 32, "0" * 32]
    rows = spark.createDataFrame([(h,) for h in hexes], "h string")
    for length in (1, 3, 5, 6, 10):
        keys = [r.k for r in rows.select(random_key(F.col("h"), length).alias("k")).collect()]
        places = [[int(h[3 * i : 3 * i + 3], 16) % 62 for i in range(length)] for h in hexes]
        assert keys == ["".join(ALPHABET[p] for p in row) for row in places]


def test_random_values_have_their_ranges(spark):
    d = digest("t", F.col("id"))
    rows = spark.range(5000).select(
        random_key(d, 10).alias("k"), uniform(d, 100).alias("u")
    ).collect()
    assert set("".join(r.k for r in rows)) == set(string.ascii_letters + string.digits)
    assert {len(r.k) for r in rows} == {10}
    assert min(r.u for r in rows) >= 0 and max(r.u for r in rows) < 100
    assert abs(sum(r.u for r in rows) / 5000 - 50) < 2


def test_sample_records_follow_the_file_sizes(spark):
    rows = sample_records(spark, {"a.gz": 1000, "b.gz": 1500}, fingerprint_length=8)
    per_file = {
        r.file_name: r
        for r in rows.groupBy("file_name")
        .agg(
            F.count("ID").alias("n"),
            F.countDistinct("Library_ID").alias("libraries"),
            F.count("FP4").alias("fp4"),
            F.max("LogP").alias("logp"),
        )
        .collect()
    }
    assert (per_file["a.gz"].n, per_file["b.gz"].n) == (1000, 1500)
    assert per_file["a.gz"].libraries == per_file["b.gz"].libraries == 1
    assert 400 < per_file["a.gz"].fp4 < 600
    assert per_file["a.gz"].logp < 10
    assert task_count(spark, 10) == 8 and task_count(spark, 40_001) == 11


def test_generation_does_not_depend_on_partitioning(spark):
    ids = spark.range(300).withColumn("file_name", F.lit("f"))
    one = generate_records(ids.coalesce(1), fingerprint_length=4)
    many = generate_records(ids.repartition(7), fingerprint_length=4)
    assert one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0


def test_spread_deals_evenly(spark):
    sizes = spread(spark.range(1000)).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 10 and all(90 <= r["count"] <= 110 for r in sizes)


def test_cluster_across_cuts_a_hot_key_and_keeps_order(spark):
    # A third of all rows share one ID.
    rows = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("i"), "id")).alias("ID")
    )
    placed = cluster_across(rows, 9, ("ID",)).withColumn("p", F.spark_partition_id())
    sizes = placed.groupBy("p").agg(
        F.count("ID").alias("n"), F.min("ID").alias("low"), F.max("ID").alias("high")
    )
    parts = sorted(sizes.collect(), key=lambda r: (r.low, r.high))
    assert sum(r.n for r in parts) == 9000
    assert max(r.n for r in parts) < 2 * 9000 / 9
    assert all(a.high <= b.low for a, b in zip(parts, parts[1:]))


def test_cluster_within_does_not_shuffle(spark):
    rows = spark.range(100).select(F.md5(F.col("id").cast("string")).alias("ID"))
    plan = cluster_within(rows, ("ID",))._jdf.queryExecution().executedPlan().toString()
    assert "Sort" in plan and "Exchange" not in plan


@given(
    st.permutations(COLUMNS),
    st.sets(st.sampled_from(COLUMNS)),
    st.lists(st.text(alphabet="abcxyz_ 1", max_size=6), max_size=4),
    st.integers(0, 12),
)
def test_any_header_matches_each_name_it_holds_once(order, missing, extras, at):
    header = [name for name in order if name not in missing]
    header[at:at] = extras
    names = column_names(header)
    assert len({n.lower() for n in names}) == len(names) == len(header)
    matched = matched_columns(names)
    assert set(matched) == set(COLUMNS) - missing
    assert all(names.index(name) == header.index(name) for name in matched.values())
    assert len(extra_columns(names)) == len(extras)
