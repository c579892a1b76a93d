"""Sources and sinks: parquet tables, typed CSV, temp views, LIBSVM,
column profiles and model save / load."""
