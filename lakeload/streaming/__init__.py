"""Incremental ingest: file-name stream, micro-batch loads, clean-up."""
