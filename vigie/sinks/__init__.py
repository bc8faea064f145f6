"""Sinks: CSV tables (X1-X4), GeoJSON features (X5), map layers."""

from .writers import geojson_feature, map_layer, parse_geojson_feature, sink_csv, sink_geojson

__all__ = ["geojson_feature", "map_layer", "parse_geojson_feature", "sink_csv", "sink_geojson"]
