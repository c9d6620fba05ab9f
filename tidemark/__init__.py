"""Release observations on Spark: extraction, indicators, change detection, confirmation."""
