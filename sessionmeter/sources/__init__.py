"""Sources, sinks and the ingest ledger."""
