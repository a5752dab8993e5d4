"""Every operator as a named query over the driver tables, with its SQL statement where SQL can say it."""

from __future__ import annotations

from importlib import import_module

from labelweave.catalog.registry import ORACLES, QUERIES

AREAS = ("text", "quality", "agreement", "splits", "metrics", "calibration", "review", "features", "training", "scoring",
         "perturbation", "files", "flows")

for _area in AREAS:
    import_module(f"labelweave.catalog.{_area}")

__all__ = ["ORACLES", "QUERIES"]
