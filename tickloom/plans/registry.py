"""All registered queries, collected from the topic modules of this package."""

from __future__ import annotations

from importlib import import_module

# Topic modules; each exposes QUERIES {name: callable} and ORACLE {name: sql}.
TOPICS = ["market", "trading", "performance", "allocation", "research", "learning", "windows", "streams", "files"]


def _collect(attribute: str) -> dict:
    merged: dict = {}
    for topic in TOPICS:
        for name, value in getattr(import_module(f"tickloom.plans.{topic}"), attribute).items():
            if name in merged:
                raise ValueError(f"query {name} registered twice")
            merged[name] = value
    return merged


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("ORACLE")
