"""Date-partitioned accounting-ledger mart on Spark."""
