"""DataFrame operators: deduplication, merges, gazetteers, enrichment, licence model, reports."""
