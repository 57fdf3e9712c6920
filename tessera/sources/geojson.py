"""GeoJSON files to rows of geom, fid and properties (JSON)."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tessera import schema as S


def _geometries(g: dict | None) -> Iterator[dict]:
    if not g:
        return
    kind, c = g["type"].lower(), g.get("coordinates")
    if kind == "geometrycollection":
        for child in g["geometries"]:
            yield from _geometries(child)
        return
    deep = {"point": [[[c]]], "multipoint": [[c]], "linestring": [[c]], "multilinestring": [c], "polygon": [c], "multipolygon": c}[kind]
    yield {"kind": kind, "parts": [[[{"x": float(p[0]), "y": float(p[1])} for p in ring] for ring in part] for part in deep]}


def read(spark: SparkSession, path: str) -> DataFrame:
    """A FeatureCollection a file, or one feature or geometry, which then has the id 1.
    The members of a collection are rows of their own with the feature's id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for content in batch["content"]:
                d = json.loads(bytes(content))
                if d["type"] == "FeatureCollection":
                    found = [(f.get("id", i), f) for i, f in enumerate(d["features"], 1)]
                else:
                    found = [(1, d if d["type"] == "Feature" else {"geometry": d})]
                rows += [{"geom": g, "fid": int(n) if isinstance(n, int) else i, "properties": json.dumps(f.get("properties") or {})} for i, (n, f) in enumerate(found, 1) for g in _geometries(f.get("geometry"))]
            yield pd.DataFrame(rows, columns=["geom", "fid", "properties"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, f"geom {S.GEOM}, fid bigint, properties string")
