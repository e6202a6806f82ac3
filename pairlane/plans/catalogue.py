"""Imports every plan module so that its queries are registered."""
import importlib

from .registry import ORACLES, QUERIES

MODULES = ["sources", "geometry", "joins", "ordered", "windows", "episodes", "inference", "words", "graph", "streams"]

for _m in MODULES:
    try:
        importlib.import_module(f"{__package__}.{_m}")
    except ModuleNotFoundError as e:
        if e.name != f"{__package__}.{_m}":
            raise

__all__ = ["QUERIES", "ORACLES"]
