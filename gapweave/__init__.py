"""gapweave: Spark operators for tables with missing values."""
