"""Readers that give frames of a declared schema."""

from .files import read_csv, read_json, read_parquet
from .remote import download, http_table, read_sheet, slices
from .vectors import read_vectors

__all__ = ["download", "http_table", "read_csv", "read_json", "read_parquet", "read_sheet", "read_vectors", "slices"]
