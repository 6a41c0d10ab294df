"""Where frames come from and go to: the named storage and Parquet tables."""

from weftline.sources.storage import Storage, storage
from weftline.sources.tables import read_table, read_tables, write_table

__all__ = ["Storage", "read_table", "read_tables", "storage", "write_table"]
