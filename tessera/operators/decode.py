"""Tiles to layers and features, checks, summaries and edits over tables of tiles."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera import schema as S
from tessera.functions import codec
from tessera.functions.tilemath import HALF
from tessera.operators import tile as T
from tessera.operators.wire import BadTile

Box = tuple[float, float, float, float]


def value(tag: int, v) -> dict:
    out = dict.fromkeys(("s", "f", "d", "i", "u", "b"))
    slot = {S.STRING: "s", S.FLOAT: "d", S.DOUBLE: "d", S.BOOL: "b"}.get(tag, "i")
    return {"tag": tag, **out, slot: v}


def _expand(df: DataFrame, fields: str, rows, carry: str = "") -> DataFrame:
    """Each tile's (z, x, y, data) to rows of ``fields``, Arrow batch by Arrow batch. The
    columns of ``carry`` are repeated in each of a tile's rows."""
    schema = StructType.fromDDL("z int, x bigint, y bigint, " + (f"{carry}, " if carry else "") + fields)
    arrow = to_arrow_schema(schema)
    kept = StructType.fromDDL(f"z int, x bigint, y bigint, {carry}" if carry else "z int, x bigint, y bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own, data in zip(batch.select(kept.names).to_pylist(), batch.column("data"), strict=True):
                out += [own | r for r in rows(own["z"], own["x"], own["y"], data.as_py() or b"")]
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in kept], "data").mapInArrow(run, schema)


def features(tiles: DataFrame, bbox: Box | None = None, names: list[str] | None = None, mode: str = "failfast", map_units: bool = True) -> DataFrame:
    """One row a feature. Coordinates are web mercator (or the tile's grid); parts
    outside ``bbox`` are left out while decoding; ``names`` are the attributes read, an
    empty list none of them. ``permissive`` puts what is wrong into ``corrupt``, in a row
    of its own, where ``failfast`` raises."""
    wanted = None if names is None else set(names)

    def rows(z: int, x: int, y: int, data: bytes):
        try:
            found = T.layers(data)
        except BadTile as e:
            if mode == "failfast":
                raise
            yield {"corrupt": str(e)}
            return
        for index, raw in enumerate(found):
            try:
                layer = T.Layer(raw)
                res = 2 * HALF / 2**z
                origin, scale = ((x * res - HALF, HALF - y * res), (layer.extent / res, -layer.extent / res)) if map_units else ((0.0, 0.0), (1.0, 1.0))
                for f in layer.read(origin, scale, bbox, wanted):
                    kind, parts = f["geom"]
                    geom = {"kind": kind, "parts": [[[{"x": float(px), "y": float(py)} for px, py in ring] for ring in part] for part in parts]}
                    yield {"layer_idx": index, "layer": layer.name, "version": layer.version, "extent": layer.extent, "fid": f["fid"], "gtype": f["gtype"], "geom": geom, "attrs": [(k, value(*v)) for k, v in f["attrs"].items()], "raster": f["raster"], "corrupt": None}
            except BadTile as e:
                if mode == "failfast":
                    raise
                yield {"layer_idx": index, "corrupt": str(e)}

    return _expand(tiles, S.FEATURE, rows)


def features_at(tiles: DataFrame, x: float, y: float, tolerance: float = 0.0, **more) -> DataFrame:
    """Features with a part near a point, with all attributes."""
    return features(tiles, (x - tolerance, y - tolerance, x + tolerance, y + tolerance), None, **more)


def pivot(found: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Attributes as columns of given types."""
    slots = {"string": "s", "double": "d", "float": "d", "boolean": "b"}
    return found.select("*", *[F.col("attrs")[k][slots.get(t, "i")].cast(t).alias(k) for k, t in columns.items()]).drop("attrs")


def layer_headers(tiles: DataFrame) -> DataFrame:
    """One row a layer: name, version, extent, sizes, keys and whether it has rasters."""

    def rows(z, x, y, data):
        for index, raw in enumerate(T.layers(data)):
            t = T.Layer(raw)
            yield {"layer_idx": index, "layer": t.name, "version": t.version, "extent": t.extent, "n_features": len(t.features), "n_keys": len(t.keys), "n_values": len(t.values), "keys": t.keys, "has_raster": t.has_raster, "corrupt": None}

    return _expand(tiles, S.HEADER, rows)


def layer(tiles: DataFrame, name: str | None = None, index: int | None = None) -> DataFrame:
    """z, x, y and the bytes of each tile's first layer of a name, or of its n-th."""

    def rows(z, x, y, data):
        for i, raw in enumerate(T.layers(data)):
            if i == index or index is None and T.layer_name_version(raw)[0] == name:
                yield {"layer_idx": i, "layer": raw}
                return

    return _expand(tiles, "layer_idx int, layer binary", rows)


def split_layers(tiles: DataFrame, carry: str = "") -> DataFrame:
    """z, x, y, the columns of ``carry``, layer_idx, name, version and each layer's bytes
    as a field of a tile."""

    def rows(z, x, y, data):
        for i, raw in enumerate(T.layers(data)):
            name, version = T.layer_name_version(raw)
            yield {"layer_idx": i, "name": name, "version": version, "part": T.W.blob(T.TILE_LAYER, raw)}

    return _expand(tiles, "layer_idx int, name string, version int, part binary", rows, carry)


_SUMMARY = "layer string, version int, extent bigint, n_features bigint, n_keys bigint, n_values bigint, n_ints bigint, n_cmds bigint, n_move bigint, n_line bigint, n_close bigint, n_degenerate bigint, n_empty bigint"


def tile_info(tiles: DataFrame) -> DataFrame:
    """Counts of features, dictionaries and commands, one row a layer."""
    return _expand(tiles, _SUMMARY, lambda z, x, y, data: map(T.summary, T.layers(data)))


def errors(tiles: DataFrame, strict: bool = False) -> DataFrame:
    """What is wrong with each layer: codes and report text, and features by type."""
    types = ["point", "line", "polygon", "unknown", "raster"]

    def rows(z, x, y, data):
        try:
            found = T.layers(data)
        except (BadTile, OSError) as e:
            code = ["tile_unknown_field" if "unknown field" in str(e) else "bad_bytes"]
            yield {"layer_idx": None, "name": None, "codes": code, "report": T.error_text(code)} | dict.fromkeys(types, 0)
            return
        seen: set[str] = set()
        for i, raw in enumerate(found):
            codes, counts = T.layer_errors(raw, strict)
            try:
                name = T.layer_name_version(raw)[0]
            except (BadTile, AttributeError):
                name = ""
            if strict and name in seen:
                codes = [c for c in T.ERRORS if c in {*codes, "layer_repeated"}]
            seen.add(name)
            yield {"layer_idx": i, "name": name, "codes": codes, "report": T.error_text(codes)} | {t: counts.get(t, 0) for t in types}

    return _expand(tiles, "layer_idx int, name string, codes array<string>, report string, " + ", ".join(f"{t} bigint" for t in types), rows)


def _edit(data: Column, change) -> Column:
    """Edited bytes in the compression they came in."""

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        import zlib

        def one(b):
            kind = 31 if b[:2] == b"\x1f\x8b" else 15 if codec.inflate(b) is not b else 0
            out = change(codec.inflate(b))
            if not kind:
                return out
            c = zlib.compressobj(-1, zlib.DEFLATED, kind)
            return c.compress(out) + c.flush()

        return s.map(one, na_action="ignore")

    return run(data)


def set_version(data: Column, version: int) -> Column:
    return _edit(data, lambda b: T.set_version(b, version))


def clean(data: Column) -> Column:
    return _edit(data, T.clean)
