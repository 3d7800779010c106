"""barflow: market time series and trading-ledger analytics as Spark DataFrame jobs."""
