"""Table operators: joins, aggregations, ordered scans, curation, evaluation, ledger, models."""
