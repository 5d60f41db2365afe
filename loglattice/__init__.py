"""Log analytics on Spark: canonical templates, deduplicated ingest, search, retention and reports."""
