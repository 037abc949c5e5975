"""Reading tables and turning event rows into regular series."""

from .tables import daily_series, load, read_csv, read_json, read_parquet, regular_series, write

__all__ = ["daily_series", "load", "read_csv", "read_json", "read_parquet", "regular_series", "write"]
