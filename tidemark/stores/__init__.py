"""Tables that are written: commits of Parquet folders, read through the last one."""
