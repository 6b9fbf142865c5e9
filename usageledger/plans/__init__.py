"""Record store, archive, enrichment and reports."""
