"""Sources and sinks: CSV edge, Parquet layer, dimension tables, stand-in data."""
