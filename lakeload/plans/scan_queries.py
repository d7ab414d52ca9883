"""Discovery, scans, generation, casts and alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeload.functions.hashing import ALPHABET, ELEMENT_COUNT, PRIME
from lakeload.functions.schema import COLUMNS
from lakeload.operators.align import cast_measures, widen_measures
from lakeload.operators.generate import (
    FINGERPRINT_LENGTH,
    ID_LENGTH,
    LIBRARY_LENGTH,
    LOGP_MAX,
    MW_MAX,
    SUB_ID_LENGTH,
    generate_records,
    task_count,
)
from lakeload.operators.layout import spread
from lakeload.plans.fixtures import (
    RECORDS_CTE,
    TABLE_COLUMNS_SQL,
    label_of,
    new_inbox,
    new_mixed_inbox,
    read,
    records,
)
from lakeload.sources.discovery import combine_files, discover_files, listed_files
from lakeload.sources.tsv import scan_files

_FINGERPRINTS = ("FP1", "FP2", "FP3", "FP4", "FP5")


def find_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the files found; an uncompressed copy of the data is not found."""
    folder = new_inbox(spark, sf_dir)
    decoy = records(spark, sf_dir).withColumn("label", F.lit("decoy"))
    decoy.write.mode("append").partitionBy("label").option("sep", "\t").csv(folder)
    found = discover_files(spark, folder, ".gz", recursive=True)
    return found.select(label_of(F.col("path")).alias("path")).distinct()


FIND_FILES_SQL = "SELECT DISTINCT o_orderpriority AS path FROM orders"


def explicit_file_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of two libraries are listed, some twice, ahead of the discovered ones."""
    found = discover_files(spark, new_inbox(spark, sf_dir), ".gz", recursive=True)
    labelled = found.withColumn("label", label_of(F.col("path")))
    chosen = labelled.filter(F.col("label").isin("3-MEDIUM", "1-URGENT"))
    paths = [r.path for r in chosen.orderBy(F.desc("label"), "path").select("path").collect()]
    files = combine_files(listed_files(spark, paths + paths), found)
    return files.groupBy(label_of(F.col("path")).alias("label")).agg(
        (F.count("position") == F.count("path")).alias("listed"),
        (F.count("path") - F.countDistinct("path")).alias("repeated"),
        (F.min("position") == 0).alias("first"),
    )


EXPLICIT_FILE_LIST_SQL = """
SELECT o_orderpriority AS label,
       o_orderpriority IN ('3-MEDIUM', '1-URGENT') AS listed,
       CAST(0 AS BIGINT) AS repeated,
       CASE o_orderpriority WHEN '3-MEDIUM' THEN TRUE WHEN '1-URGENT' THEN FALSE END AS first
FROM orders GROUP BY o_orderpriority"""


def tsv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = discover_files(spark, new_inbox(spark, sf_dir), ".gz", recursive=True)
    return scan_files(found).select(*COLUMNS)


TSV_SCAN_SQL = f"{RECORDS_CTE} SELECT * FROM records"


def cast_measures_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = discover_files(spark, new_inbox(spark, sf_dir), ".gz", recursive=True)
    return widen_measures(cast_measures(scan_files(found))).select("ID", "MW", "LogP")


CAST_MEASURES_SQL = f"""{RECORDS_CTE}
SELECT ID, CAST(TRY_CAST(MW AS FLOAT) AS DOUBLE) AS MW,
       CAST(TRY_CAST(LogP AS FLOAT) AS DOUBLE) AS LogP
FROM records"""


def align_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three headers: canonical, reversed, and without FP3 but with a column more."""
    found = discover_files(spark, new_mixed_inbox(spark, sf_dir), ".gz", recursive=True)
    return widen_measures(cast_measures(scan_files(found))).select(*COLUMNS)


ALIGN_SCHEMA_SQL = f"""{RECORDS_CTE}
SELECT {TABLE_COLUMNS_SQL} FROM (
  SELECT * REPLACE (CASE WHEN Library_ID IN ('1-URGENT', '2-HIGH') THEN FP3 END AS FP3)
  FROM records)"""


def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sample record per order, a file per priority; vectors at full length, as digests."""
    rows = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("file_name")
    )
    sample = generate_records(spread(rows, task_count(spark, rows.count())))
    plain = [name for name in COLUMNS if name not in _FINGERPRINTS]
    return sample.select(
        *plain,
        *[F.md5(name).alias(name) for name in _FINGERPRINTS],
        # Digits and commas: a byte each, which need not be looked at to be counted.
        F.octet_length("FP1").alias("FP1_chars"),
    )


def _digest_sql(tag: str, *parts: str) -> str:
    return f"md5(concat_ws('|', '{tag}', {', '.join(f'CAST({p} AS VARCHAR)' for p in parts)}))"


def _hex_sql(digest: str, start: int, length: int) -> str:
    return f"CAST(concat('0x', substr({digest}, {start}, {length})) AS BIGINT)"


def _key_sql(digest: str, length: int) -> str:
    chars = [
        f"substr('{ALPHABET}', {_hex_sql(digest, 1 + 3 * i, 3)} % {len(ALPHABET)} + 1, 1)"
        for i in range(length)
    ]
    return f"concat({', '.join(chars)})"


def _generate_sql() -> str:
    def of_row(tag: str) -> str:
        return _digest_sql(tag, "o_orderpriority", "o_orderkey")

    def measure(tag: str, high: int) -> str:
        return f"{_hex_sql(of_row(tag), 1, 8)} / 4294967296.0::DOUBLE * {high}::DOUBLE"

    def vector(name: str) -> str:
        start, step = f"{name}_start", f"{name}_step"
        points = f"range({start}, {start} + {FINGERPRINT_LENGTH} * {step}, {step})"
        element = f"x * x % {PRIME} % {ELEMENT_COUNT}"
        return f"array_to_string(list_transform({points}, lambda x: {element}), ',')"

    columns = {
        "ID": _key_sql(of_row("ID"), ID_LENGTH),
        "Library_ID": _key_sql(_digest_sql("Library_ID", "o_orderpriority"), LIBRARY_LENGTH),
        "MW": measure("MW", MW_MAX),
        "LogP": measure("LogP", LOGP_MAX),
    }
    for name in ("Sub_ID_1", "Sub_ID_2", "Sub_ID_3"):
        columns[name] = _key_sql(of_row(name), SUB_ID_LENGTH)
    seeds = {}
    for name in _FINGERPRINTS:
        seeds[f"{name}_start"] = _hex_sql(of_row(name), 1, 7)
        seeds[f"{name}_step"] = _hex_sql(of_row(name), 8, 5) + " + 1"
        columns[name] = f"md5({vector(name)})"
    for name in ("FP4", "FP5"):
        seeds[f"{name}_present"] = f"{_hex_sql(of_row(name + ' present'), 1, 8)} % 2 = 0"
        columns[name] = f"CASE WHEN {name}_present THEN {columns[name]} END"
    columns["FP1_chars"] = f"CAST(length({vector('FP1')}) AS INTEGER)"

    def select_list(named: dict[str, str]) -> str:
        return ",\n       ".join(f"{sql} AS {name}" for name, sql in named.items())

    return f"""WITH seeds AS (SELECT o_orderpriority, o_orderkey,
       {select_list(seeds)}
FROM orders)
SELECT {select_list(columns)}
FROM seeds"""


GENERATE_SQL = _generate_sql()
