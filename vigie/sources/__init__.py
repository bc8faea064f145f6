"""Scans of the reference's feed formats and their stand-ins from the driver tables."""

from . import schemas, standins
from .readers import geojson_schema, list_files, scan_csv, scan_geojson

__all__ = ["schemas", "standins", "geojson_schema", "list_files", "scan_csv", "scan_geojson"]
