"""A relational engine on Spark: a small SQL dialect, versioned tables, transactions, statistics and indexes as metadata."""
