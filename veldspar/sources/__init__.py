"""Readers of files and the dataset package."""

from .connectors import Loaded, SourceError, find_connector, inspect, read_dataset
from .package import export_csv, load_package, package_stats, save_package

__all__ = ["Loaded", "SourceError", "export_csv", "find_connector", "inspect", "load_package", "package_stats", "read_dataset", "save_package"]
