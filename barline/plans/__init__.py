"""Plan building blocks: series blocks, scans, range joins, exact quantiles, replicates."""
