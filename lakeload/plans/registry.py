"""Query names, their Spark side and their SQL side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakeload.plans import ingest_queries as i
from lakeload.plans import scan_queries as s
from lakeload.plans import table_queries as t

Query = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, tuple[Query, str]] = {
    "discover_files": (s.find_files, s.FIND_FILES_SQL),
    "explicit_file_list": (s.explicit_file_list, s.EXPLICIT_FILE_LIST_SQL),
    "tsv_scan": (s.tsv_scan, s.TSV_SCAN_SQL),
    "generate_records": (s.generated, s.GENERATE_SQL),
    "cast_measures": (s.cast_measures_query, s.CAST_MEASURES_SQL),
    "align_schema": (s.align_schema, s.ALIGN_SCHEMA_SQL),
    "staged_preview": (t.staged_preview, t.STAGED_PREVIEW_SQL),
    "loaded_rows": (t.loaded_rows, t.LOADED_ROWS_SQL),
    "rejects": (t.rejects, t.REJECTS_SQL),
    "malformed_rows": (t.malformed_rows, t.MALFORMED_ROWS_SQL),
    "null_profile": (t.null_profile, t.NULL_PROFILE_SQL),
    "repartition_layout": (t.repartition_layout, t.REPARTITION_LAYOUT_SQL),
    "table_layout": (t.table_layout, t.TABLE_LAYOUT_SQL),
    "split_source_layout": (t.split_source_layout, t.SPLIT_SOURCE_LAYOUT_SQL),
    "hot_id": (t.hot_id, t.HOT_ID_SQL),
    "catalog_table": (t.catalog_table, t.CATALOG_TABLE_SQL),
    "long_vectors": (t.long_vectors, t.LONG_VECTORS_SQL),
    "lookup_by_id": (t.lookup, t.LOOKUP_SQL),
    "lookup_in_library": (t.lookup_in_library, t.LOOKUP_SQL),
    "compacted_lookup": (t.compacted_lookup, t.LOOKUP_SQL),
    "compacted_reingest": (t.compacted_reingest, t.COMPACTED_REINGEST_SQL),
    "bucketed_lookup": (t.bucketed_lookup, t.BUCKETED_LOOKUP_SQL),
    "warehouse_growth": (t.warehouse_growth, t.WAREHOUSE_GROWTH_SQL),
    "pending_files": (i.pending, i.PENDING_SQL),
    "incremental_ingest": (i.incremental, i.INCREMENTAL_SQL),
    "replay_idempotent": (i.replay, i.REPLAY_SQL),
    "forced_reingest": (i.forced_reingest, i.FORCED_REINGEST_SQL),
    "quarantine_files": (i.quarantine, i.QUARANTINE_SQL),
    "cleanup_consumed": (i.cleanup, i.CLEANUP_SQL),
    "load_metrics": (i.load_metrics, i.LOAD_METRICS_SQL),
    "run_progress": (i.run_progress, i.RUN_PROGRESS_SQL),
}
