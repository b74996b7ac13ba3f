"""Sources and sinks: declared schemas, CSV/parquet I/O, driver-table fixtures."""
