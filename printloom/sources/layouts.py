"""Layouts as JSON: one file for a layout; defaults for what is left out; an explicit null stays null."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import SparkSession

from printloom.layout import AnchorSpec, Column, PageSpec, TableSpec


def to_dict(spec: TableSpec) -> dict:
    page = asdict(spec.page) | {"watermarks": sorted(spec.page.watermarks)}
    return {"right_edge": spec.right_edge, "columns": [asdict(c) for c in spec.columns], "anchor": asdict(spec.anchor), "page": page}


def from_dict(data: dict) -> TableSpec:
    columns = tuple(Column(c["name"], float(c["left"]), c.get("kind", "en")) for c in data["columns"])
    page = dict(data.get("page") or {})
    page["watermarks"] = frozenset(page.get("watermarks") or ())
    return TableSpec(columns, float(data["right_edge"]), AnchorSpec(**(data.get("anchor") or {})), PageSpec(**page))


def save(spec: TableSpec, path: str) -> str:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(to_dict(spec), f, indent=2, ensure_ascii=False)
    return path


def load(path: str, spark: SparkSession | None = None) -> TableSpec:
    """From a local file, or through Spark from any store that it reads."""
    if spark is None:
        with open(path, encoding="utf-8") as f:
            return from_dict(json.load(f))
    return from_dict(json.loads(spark.read.text(path, wholetext=True).first()[0]))
