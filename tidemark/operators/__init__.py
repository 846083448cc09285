"""DataFrame operators: filters, alignment, rollup, deduplication, catalogue, expiration."""
