"""The driver's tables in the shape of input records, and folders of input files made of them."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeload.functions.paths import scratch_dir
from lakeload.functions.schema import COLUMNS
from lakeload.sources.discovery import discover_files
from lakeload.sources.files import map_paths, resolve
from lakeload.sources.tsv import write_tsv
from lakeload.streaming.ingest import ingest
from lakeload.streaming.load import IngestOptions

# One select list for both engines; {text} is the name of the string type.
_RECORD_COLUMNS = """
    concat('O', CAST(o_orderkey AS {text})) AS ID,
    o_orderpriority AS Library_ID,
    o_orderstatus AS Sub_ID_1,
    CAST(o_custkey AS {text}) AS Sub_ID_2,
    CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE substr(o_orderpriority, 1, 1) END AS Sub_ID_3,
    CASE WHEN o_orderkey % 89 = 0 THEN 'bad' ELSE CAST(o_totalprice AS {text}) END AS MW,
    CAST(o_custkey AS {text}) AS LogP,
    concat_ws(',', CAST(o_custkey % 1001 AS {text}), CAST(o_orderkey % 1001 AS {text})) AS FP1,
    concat_ws(',', CAST(o_orderkey % 997 AS {text}), '0') AS FP2,
    CAST(o_custkey % 13 AS {text}) AS FP3,
    CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE '1,2,3' END AS FP4,
    CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE '4,5,6' END AS FP5"""

RECORDS_CTE = f"WITH records AS (SELECT {_RECORD_COLUMNS.format(text='VARCHAR')} FROM orders)"

# A record as the table holds it, in SQL over ``records``.
TABLE_COLUMNS_SQL = ", ".join(
    f"CAST(TRY_CAST({c} AS FLOAT) AS DOUBLE) AS {c}" if c in ("MW", "LogP") else c
    for c in COLUMNS
)
VALID_SQL = "TRY_CAST(MW AS FLOAT) IS NOT NULL"

# Inboxes are trees with one folder per label.
INBOX = IngestOptions(extension=".tsv.gz", recursive=True)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as twelve text columns."""
    columns = _RECORD_COLUMNS.format(text="STRING")
    return spark.sql(f"SELECT {columns} FROM {{orders}}", orders=read(spark, sf_dir, "orders"))


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as twelve text columns; ``Sub_ID_2`` is the day."""
    zero, none = F.lit("0"), F.lit(None).cast("string")
    values = {
        "ID": F.col("event_id").cast("string"),
        "Library_ID": F.col("event_type"),
        "Sub_ID_1": F.col("user_id").cast("string"),
        "Sub_ID_2": F.col("ts").cast("date").cast("string"),
        "MW": F.col("value").cast("string"),
        "LogP": zero,
        "FP1": zero,
        "FP2": zero,
        "FP3": zero,
    }
    return read(spark, sf_dir, "events").select(
        *[values.get(name, none).alias(name) for name in COLUMNS]
    )


def embedding_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as twelve text columns; ``FP1`` to ``FP3`` are the vector as integers."""
    vector = F.array_join(
        F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("int")), ","
    )
    none = F.lit(None).cast("string")
    values = {
        "ID": F.concat(F.lit("V"), F.col("vec_id").cast("string")),
        "Library_ID": F.concat(F.lit("0"), F.col("label").cast("string")),
        "Sub_ID_1": F.col("label").cast("string"),
        "Sub_ID_2": F.col("vec_id").cast("string"),
        "MW": F.lit("1.5"),
        "LogP": F.col("label").cast("string"),
        "FP1": vector,
        "FP2": vector,
        "FP3": vector,
    }
    return read(spark, sf_dir, "embeddings").select(
        *[values.get(name, none).alias(name) for name in COLUMNS]
    )


def label_of(path: Column) -> Column:
    """The label of a file in an inbox."""
    return F.regexp_extract(path, "/label=([^/]+)/", 1)


def write_inbox(rows: DataFrame, label: str, folder: str, mode: str = "append") -> None:
    """Gzip TSV files below ``folder``, one sub-folder per value of the column ``label``.

    The label column stays in the files.
    """
    write_tsv(rows.withColumn("label", F.col(label)), folder, "label", mode=mode)


def new_inbox(spark: SparkSession, sf_dir: str) -> str:
    """All ``records`` as input files, a folder per library."""
    folder = scratch_dir(spark, "inbox")
    write_inbox(records(spark, sf_dir), "Library_ID", folder)
    return folder


def new_mixed_inbox(spark: SparkSession, sf_dir: str) -> str:
    """All ``records``; one library with the columns reversed, others without ``FP3`` and
    with a column more."""
    folder = scratch_dir(spark, "mixed")
    rows = records(spark, sf_dir)
    library = F.col("Library_ID")
    write_inbox(rows.filter(library == "1-URGENT"), "Library_ID", folder)
    reversed_columns = rows.select(*reversed(COLUMNS))
    write_inbox(reversed_columns.filter(library == "2-HIGH"), "Library_ID", folder)
    other = rows.withColumn("Batch_Note", F.lit("x,y")).drop("FP3")
    write_inbox(
        other.filter(~library.isin("1-URGENT", "2-HIGH")), "Library_ID", folder
    )
    return folder


def new_table(spark: SparkSession, sf_dir: str) -> str:
    """A table with all valid ``records``, loaded from input files."""
    root = scratch_dir(spark, "table")
    ingest(spark, new_inbox(spark, sf_dir), root, options=INBOX)
    return root


def copy_halves(files: DataFrame, folder: str) -> int:
    """Copy the first half of each file into ``folder``, under its label; for damage tests."""

    def copy(path: str) -> dict:
        fs, source = resolve(path)
        label_folder, name = source.split("/")[-2:]
        target = f"{resolve(folder)[1]}/{label_folder}"
        fs.create_dir(target, recursive=True)
        left = fs.get_file_info(source).size // 2
        with (
            fs.open_input_stream(source, compression=None) as src,
            fs.open_output_stream(f"{target}/{name}", compression=None) as dst,
        ):
            while left and (piece := src.read(min(left, 1 << 20))):
                dst.write(piece)
                left -= len(piece)
        return {"path": path}

    return map_paths(files, copy, "path string").count()


def new_damaged_inbox(spark: SparkSession, sf_dir: str, damaged: str = "5-LOW") -> str:
    """All ``records`` as input files; those of one library are cut off halfway."""
    rows = records(spark, sf_dir)
    folder, aside = scratch_dir(spark, "inbox"), scratch_dir(spark, "aside")
    write_inbox(rows.filter(F.col("Library_ID") != damaged), "Library_ID", folder)
    write_inbox(rows.filter(F.col("Library_ID") == damaged), "Library_ID", aside)
    copy_halves(discover_files(spark, aside, ".tsv.gz", recursive=True), folder)
    return folder
