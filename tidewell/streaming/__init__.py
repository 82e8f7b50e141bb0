"""Live ingestion with watermarks and keyed state."""
