"""Collects every query module."""

from __future__ import annotations

import importlib
import pkgutil

import tidewatch.plans as plans
from tidewatch.plans.registry import REGISTRY, Query

_SKIP = {"catalog", "registry", "standins"}


def load() -> dict[str, Query]:
    for module in sorted(m.name for m in pkgutil.iter_modules(plans.__path__)):
        if module not in _SKIP:
            importlib.import_module(f"tidewatch.plans.{module}")
    return REGISTRY
