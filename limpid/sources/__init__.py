"""Sources and sinks."""

from limpid.sources.csv import preview, read_csv, table_from_text, write_csv

__all__ = ["preview", "read_csv", "table_from_text", "write_csv"]
