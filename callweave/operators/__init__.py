"""DataFrame-level operators: joins, shards, clustering, aggregation, ingestion checks."""
