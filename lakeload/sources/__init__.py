"""Files in, tables out: discovery, scans, sinks, the row store and the ledger."""
