"""Personal-data detection and risk analytics over Spark tables."""
