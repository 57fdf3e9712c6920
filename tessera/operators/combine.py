"""Tiles from tiles: merge, composite, overzoom and upgrade."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera import schema as S
from tessera.functions.tilemath import HALF
from tessera.operators import decode as D
from tessera.operators import encode as E
from tessera.operators import tile as T


def _join_parts(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    parts = sorted(table.select(["turn", "src", "layer_idx", "part"]).to_pylist(), key=lambda r: (r["turn"], r["src"], r["layer_idx"]))
    return pa.table({"z": pa.array([key[0].as_py()], pa.int32()), "x": pa.array([key[1].as_py()], pa.int64()), "y": pa.array([key[2].as_py()], pa.int64()), "data": pa.array([b"".join(r["part"] for r in parts)], pa.binary())})


def concat_layers(parts: DataFrame) -> DataFrame:
    """(z, x, y, src, layer_idx, name, part) to tiles: of layers with one name the first
    by turn (if there), src and layer_idx stays, nameless ones go, bytes are copied."""
    if "turn" not in parts.columns:
        parts = parts.withColumn("turn", F.lit(0))
    first = Window.partitionBy("z", "x", "y", "name").orderBy("turn", "src", "layer_idx")
    kept = parts.where("name <> ''").withColumn("place", F.row_number().over(first)).where("place = 1")
    return kept.groupBy("z", "x", "y").applyInArrow(_join_parts, S.TILE)


def merge(tiles: DataFrame, validate: bool = False, upgrade: bool = False) -> DataFrame:
    """``tiles`` (z, x, y, src, data), compressed or not, merged by address. With
    ``validate`` layers with errors raise; with ``upgrade`` layers of version 1 are
    encoded anew as version 2."""
    data = tiles.select("z", "x", "y", "src", "data")
    if validate:
        bad = D.errors(data, strict=True).where("size(codes) > 0").select("report").first()
        if bad:
            raise ValueError(bad.report)
    parts = D.split_layers(data, "src int")
    if upgrade:
        parts = parts.withColumn("part", F.when(F.col("version") == 1, upgraded("part")).otherwise(F.col("part")))
    return concat_layers(parts)


WINDOW = 4096  # cells around a tile that an upgrade keeps


def upgraded(part: str, tile_size: int = 4096):
    """A layer field decoded as version 1 and encoded as version 2 at the tile's size. What
    lies within WINDOW cells of the tile is kept, polygons are joined under the even-odd
    rule with all their rings."""
    box = (-WINDOW, -WINDOW, tile_size + WINDOW, tile_size + WINDOW)

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        def one(b):
            layer = T.Layer(T.layers(b)[0])
            w = T.LayerWriter(layer.name, tile_size)
            per_cell = layer.extent / tile_size
            for f in layer.read(scale=(per_cell, per_cell), bbox=box):
                attrs = {k: v for k, (_, v) in f["attrs"].items()}
                if f["raster"] is not None:
                    w.add_raster(f["raster"], f["fid"], attrs)
                else:
                    kind, parts = f["geom"]
                    whole = (kind, [[[(T.G._half_up(x), T.G._half_up(y)) for x, y in r] for r in p] for p in parts])
                    w.add(T.G.clip(whole, box, process_all_rings=True, fill="even_odd", union=True), f["fid"], attrs)
            return w.bytes()

        return s.map(one, na_action="ignore")

    return run(part)


def upgrade(tiles: DataFrame) -> DataFrame:
    parts = D.split_layers(tiles).withColumn("src", F.lit(0))
    return concat_layers(parts.withColumn("part", F.when(F.col("version") == 1, upgraded("part")).otherwise(F.col("part"))))


def update(tiles: DataFrame, z: int, encoder: E.TileEncoder) -> DataFrame:
    """``tiles`` (z, x, y, and data, which may be null) of a zoom with the encoder's layers
    behind their own. A layer whose name a tile holds already is skipped there, before it
    is encoded. Tiles that hold nothing and get nothing are left out."""
    here = tiles.where(F.col("z") == z)
    own = D.split_layers(here.where("length(data) > 0")).withColumn("src", F.lit(0))
    fresh = encoder.encode(z, here.select("x", "y").distinct(), own.select("x", "y", "name"))
    return concat_layers(own.unionByName(D.split_layers(fresh).withColumn("src", F.lit(1))))


def composite(targets: DataFrame, sources: DataFrame, reencode: bool = False, options: E.EncodeOptions | None = None) -> DataFrame:
    """Targets (z, x, y, and data, which may be null) with the layers of ``sources``
    (z, x, y, src, data) of the same address or of one above it. Layers of the same
    address are copied unless ``reencode``; others are decoded and encoded for the target
    (overzoom). A layer whose name is there already is skipped."""
    options = options or E.EncodeOptions()
    own = D.split_layers(targets.where("length(data) > 0").withColumn("src", F.lit(-1)), "src int")
    key = targets.select(F.col("z").alias("tz"), F.col("x").alias("tx"), F.col("y").alias("ty")).distinct()
    # an ancestor's key is the target's, shifted: an equi-join
    up = key.withColumn("z", F.explode(F.sequence(F.lit(0), F.col("tz")))).withColumns({"x": F.expr("shiftright(tx, tz - z)"), "y": F.expr("shiftright(ty, tz - z)")})
    met = sources.select(F.col("z").cast("int").alias("z"), "x", "y", "src", "data").where("length(data) > 0").join(up, ["z", "x", "y"])
    same = (F.col("z") == F.col("tz")) & F.lit(not reencode)
    copied = D.split_layers(met.where(same), "src int")
    # copies come before all that is encoded anew, whatever the order of their sources
    anew = _reencoded(met.where(~same).select("tz", "tx", "ty", "z", "x", "y", "src", "data"), options)
    columns = ["z", "x", "y", "src", "layer_idx", "name", "version", "part"]
    parts = [d.select(*[F.col(c) for c in columns], F.lit(i).alias("turn")) for i, d in enumerate((own, copied, anew))]
    return concat_layers(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def _reencoded(rows: DataFrame, o: E.EncodeOptions) -> DataFrame:
    """Layers of a tile encoded for a tile at or below it."""

    def run(batches):
        for batch in batches:
            out = []
            for tz, tx, ty, z, x, y, src, data in zip(*(batch.column(c).to_pylist() for c in ("tz", "tx", "ty", "z", "x", "y", "src", "data")), strict=True):
                res, side = 2 * HALF / 2**z, 2 * HALF / 2**tz
                left, top = tx * side - HALF, HALF - ty * side
                pad = o.buffer_size * side / o.tile_size
                box = (left - pad, top - side - pad, left + side + pad, top + pad)
                for index, raw in enumerate(T.layers(data)):
                    layer = T.Layer(raw)
                    w = T.LayerWriter(layer.name, o.tile_size)
                    for f in layer.read((x * res - HALF, HALF - y * res), (layer.extent / res, -layer.extent / res), box):
                        attrs = {k: v for k, (_, v) in f["attrs"].items()}
                        if f["raster"] is not None:
                            w.add_raster(f["raster"], f["fid"], attrs)
                            continue
                        geom = {"kind": f["geom"][0], "parts": [[[{"x": a, "y": b} for a, b in r] for r in p] for p in f["geom"][1]]}
                        local = E._to_grid(geom, box, left, top, o.tile_size / side, o)
                        edge = (-o.buffer_size, -o.buffer_size, o.tile_size + o.buffer_size, o.tile_size + o.buffer_size)
                        w.add(T.G.clip(local, edge, o.area_threshold, o.process_all_rings, o.fill_type, o.multi_polygon_union), f["fid"], attrs)
                    if w.n:
                        out.append({"z": tz, "x": tx, "y": ty, "src": src, "layer_idx": index, "name": layer.name, "version": 2, "part": w.bytes()})
            schema = pa.schema([("z", pa.int32()), ("x", pa.int64()), ("y", pa.int64()), ("src", pa.int32()), ("layer_idx", pa.int32()), ("name", pa.string()), ("version", pa.int32()), ("part", pa.binary())])
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return rows.withColumn("src", F.col("src").cast("int")).mapInArrow(run, "z int, x bigint, y bigint, src int, layer_idx int, name string, version int, part binary")
