"""tunerline: channel and guide ingestion, name resolution and incremental publishing on Spark."""
