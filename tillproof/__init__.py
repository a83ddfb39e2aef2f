"""tillproof: data quality, star schema and business metrics for retail feeds, on Spark."""
