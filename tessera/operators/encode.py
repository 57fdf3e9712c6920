"""Layers of features to tiles: every tile of a zoom in one job."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import schema as S
from tessera.functions import cmds as C
from tessera.functions import tilemath as M
from tessera.operators import geometry as G
from tessera.operators import lines as L
from tessera.operators.tile import LayerWriter, feature_geometry


@dataclass(frozen=True)
class LayerSpec:
    """A layer: ``source`` has geom (schema.GEOM, map units), fid and attribute columns;
    ``attributes`` None means all. ``buffer`` overrides the tile's, in 256ths of the
    extent. Layers outside their scale denominators are left out. ``bounds`` names four
    columns with each feature's minx, miny, maxx and maxy in source units: what lies outside
    the encoder's max_extent is then left out by comparisons that reach the scan."""

    name: str
    source: DataFrame
    srs: int = 3857
    attributes: tuple[str, ...] | None = None
    buffer: int | None = None
    min_scale: float = 0.0
    max_scale: float = float("inf")
    extent: int | None = None
    bounds: tuple[str, str, str, str] | None = None


@dataclass(frozen=True)
class EncodeOptions:
    """``max_extent`` (minx, miny, maxx, maxy in web mercator) cuts every tile's buffered
    extent: nothing outside it is encoded."""

    tile_size: int = 4096
    buffer_size: int = 0
    scale_denominator: float = 0.0
    scale_factor: float = 1.0
    offset_x: int = 0
    offset_y: int = 0
    simplify_distance: float = 0.0
    area_threshold: float = 0.1
    process_all_rings: bool = False
    multi_polygon_union: bool = False
    strictly_simple: bool = True
    fill_type: str = "positive"
    max_tiles_per_feature: int = 1 << 20
    max_extent: tuple[float, float, float, float] | None = None

    def __post_init__(self):
        if self.tile_size < 0:
            raise ValueError("tile_size is not negative")
        if self.fill_type not in G.FILL_RULES:
            raise ValueError(f"no fill rule {self.fill_type}")


def point(x: Column, y: Column) -> Column:
    """A point geometry; null coordinates give a null."""
    p = F.array(F.array(F.array(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))))
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(F.lit("point").alias("kind"), p.alias("parts")).cast(S.GEOM))


def geometry(kind: str, parts: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), parts.alias("parts")).cast(S.GEOM)


def attributes(df: DataFrame, names: list[str]) -> Column:
    """map of name to typed value; nulls are left out. Decimals become doubles, and what
    else is no number, string or truth value becomes text (nested values JSON)."""
    entries = []
    kinds = dict(df.dtypes)
    none = {"s": "string", "f": "float", "d": "double", "i": "bigint", "u": "bigint", "b": "boolean"}
    for name in names:
        c, kind = F.col(f"`{name}`"), kinds[name]
        if kind in ("tinyint", "smallint", "int", "bigint"):
            tag, own = F.lit(S.INT), {"i": c.cast("bigint")}
        elif kind in ("float", "double") or kind.startswith("decimal"):
            d = c.cast("double")
            tag, own = F.when(C.wire_type(d) == "float", S.FLOAT).otherwise(S.DOUBLE), {"d": d}
        elif kind == "boolean":
            tag, own = F.lit(S.BOOL), {"b": c}
        else:
            tag, own = F.lit(S.STRING), {"s": F.to_json(c) if kind.startswith(("struct", "array", "map")) else c.cast("string")}
        value = F.struct(tag.cast("tinyint").alias("tag"), *[own.get(k, F.lit(None).cast(t)).alias(k) for k, t in none.items()])
        entries.append(F.when(c.isNotNull(), F.struct(F.lit(name).alias("key"), value.alias("value"))))
    if not entries:
        return F.create_map().cast(f"map<string,{S.VALUE}>")
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull()))


def plain(value: dict | None):
    """The Python value of a schema.VALUE."""
    if value is None:
        return None
    tag = value["tag"]
    if tag in (S.FLOAT, S.DOUBLE):
        return value["d"] if value["d"] is not None else value["f"]
    return value["s"] if tag == S.STRING else value["b"] if tag == S.BOOL else value["i"]


def to_mercator(geom: Column) -> Column:
    """Longitudes and latitudes to web mercator; vertices at the poles go."""
    move = lambda p: M.lonlat_to_mercator(p["x"], p["y"])
    parts = F.transform(geom["parts"], lambda part: F.transform(part, lambda r: F.filter(F.transform(r, move), lambda p: p.isNotNull())))
    return F.struct(geom["kind"].alias("kind"), parts.alias("parts"))


def envelope(geom: Column) -> Column:
    points = F.flatten(F.flatten(geom["parts"]))
    return C.envelope(points)


def _to_commands(o: EncodeOptions, extent: int, buffer_cells: float, z: int):
    """Filter, transform, simplify, clip and encode in one pass over Arrow batches: lines as
    arrays, other kinds and what arrays can't take exactly one by one."""
    side = 2 * M.HALF / 2**z
    pad = buffer_cells * side / extent
    low, high = (G._half_up(-buffer_cells) - o.offset_x, G._half_up(extent + buffer_cells) - o.offset_x), (G._half_up(-buffer_cells) - o.offset_y, G._half_up(extent + buffer_cells) - o.offset_y)

    def one(x: int, y: int, geom: dict) -> bytes | None:
        left, top = x * side - M.HALF, M.HALF - y * side
        box = (left - pad, top - side - pad, left + side + pad, top + pad)
        edge = None
        if o.max_extent is not None:
            m = o.max_extent
            box = (max(box[0], m[0]), max(box[1], m[1]), min(box[2], m[2]), min(box[3], m[3]))
            if box[0] > box[2] or box[1] > box[3]:
                return None
            cell = lambda v, shift: G._half_up(v * extent / side - shift)
            edge = (cell(box[0] - left, o.offset_x), cell(top - box[3], o.offset_y), cell(box[2] - left, o.offset_x), cell(top - box[1], o.offset_y))
        local = _to_grid(geom, box, left, top, extent / side, o)
        if o.simplify_distance > 0:
            local = G.simplify(local, o.simplify_distance)
        local = G.clip(local, edge or (low[0], high[0], low[1], high[1]), o.area_threshold, o.process_all_rings, o.fill_type, o.multi_polygon_union)
        coded = G.encode(local)
        return None if coded is None else feature_geometry(*coded)

    def lines(x: np.ndarray, y: np.ndarray, geom: pa.StructArray):
        left, top = x * side - M.HALF, M.HALF - y * side
        box = (left - pad, top - side - pad, left + side + pad, top + pad)
        edge = [np.full(len(x), v, np.int64) for v in (low[0], high[0], low[1], high[1])]
        if o.max_extent is not None:
            m = o.max_extent
            box = (np.maximum(box[0], m[0]), np.maximum(box[1], m[1]), np.minimum(box[2], m[2]), np.minimum(box[3], m[3]))
            cell = lambda v, shift: L.half_up(v * extent / side - shift)
            edge = [cell(box[0] - left, o.offset_x), cell(top - box[3], o.offset_y), cell(box[2] - left, o.offset_x), cell(top - box[1], o.offset_y)]
            gone = (box[0] > box[2]) | (box[1] > box[3])
            box = (np.where(gone, np.inf, box[0]), *box[1:])  # met by nothing
        return L.encode(geom, left, top, box, edge, extent / side, o.offset_x, o.offset_y, o.simplify_distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, geom = (batch.column(c) for c in ("x", "y", "geom"))
            done, keep, codes = lines(x.to_numpy(), y.to_numpy(), geom)
            rest = np.setdiff1d(np.arange(len(geom)), done)
            if len(rest):
                own = [one(*r) for r in zip(*(c.take(pa.array(rest)).to_pylist() for c in (x, y, geom)), strict=True)]
                found = pa.array([c for c in own if c is not None], pa.binary())
                keep = np.concatenate([keep, rest[[c is not None for c in own]]])
                turn = np.argsort(keep, kind="stable")
                keep, codes = keep[turn], pa.concat_arrays([codes, found]).take(pa.array(turn))
            cols = [batch.column(c).take(pa.array(keep)) for c in ("x", "y", "ord", "fid", "attrs")]
            yield pa.RecordBatch.from_arrays([*cols, codes], names=["x", "y", "ord", "fid", "attrs", "code"])

    return run


def _to_grid(geom: dict, box, left: float, top: float, per_unit: float, o: EncodeOptions) -> tuple[str, list]:
    """Parts that meet the buffered extent, on the tile's grid."""
    kind = geom["kind"]
    out = []
    for part in geom["parts"] or []:
        rings = []
        for n, ring in enumerate(part):
            points = [(p["x"], p["y"]) for p in ring]
            if kind in ("point", "multipoint"):
                points = [p for p in points if box[0] <= p[0] <= box[2] and box[1] <= p[1] <= box[3]]
            if not points or not G._meets(points, box):
                if n == 0 and kind in ("polygon", "multipolygon"):
                    break
                continue
            grid = [((px - left) * per_unit - o.offset_x, (top - py) * per_unit - o.offset_y) for px, py in points]
            grid = [(G._half_up(a), G._half_up(b)) for a, b in grid if abs(a) < 2.0**62 and abs(b) < 2.0**62]
            if grid:
                rings.append(grid)
        if rings:
            out.append(rings)
    return (kind, out) if out else G.EMPTY


def encode_features(layer: LayerSpec, z: int, options: EncodeOptions, tiles: DataFrame | None = None) -> DataFrame | None:
    """(x, y, ord, fid, attrs, code: the bytes of type and geometry) of a layer on all tiles it meets at a zoom, or
    on those in ``tiles`` (x, y); None if the layer isn't visible at this scale."""
    if layer.srs not in (3857, 4326):
        raise ValueError(f"srs {layer.srs} is not supported; 3857 and 4326 are")
    side = 2 * M.HALF / 2**z
    scale = (options.scale_denominator if options.scale_denominator > 0 else side / 256 / 0.00028) * options.scale_factor
    if not layer.min_scale <= scale <= layer.max_scale:
        return None
    extent = layer.extent or options.tile_size
    cells = float(options.buffer_size) if layer.buffer is None else layer.buffer * extent / 256
    df, ends = layer.source, ("minx", "miny", "maxx", "maxy")
    if options.max_extent is not None:
        most = F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(ends, options.max_extent, strict=True)])
        if layer.bounds is not None:
            df = df.where(M.intersects(F.struct(*[F.col(f"`{c}`").alias(n) for n, c in zip(ends, layer.bounds, strict=True)]), M.source_box(most, layer.srs)))
    names = [c for c in df.columns if c not in ("geom", "fid", "ord")] if layer.attributes is None else list(layer.attributes)
    geom = to_mercator(F.col("geom")) if layer.srs == 4326 else F.col("geom")
    rows = df.select(geom.alias("geom"), F.col("fid").cast("long").alias("fid"), (F.col("ord") if "ord" in df.columns else F.col("fid")).cast("long").alias("ord"), attributes(df, names).alias("attrs"))
    rows = rows.where("geom is not null and geom.kind <> 'empty'").withColumn("box", envelope(F.col("geom"))).where("box.minx is not null")
    if options.max_extent is not None:
        rows = rows.where(M.intersects(F.col("box"), most)).withColumn("box", F.struct(*[pick(F.col("box")[n], most[n]).alias(n) for n, pick in (("minx", F.greatest), ("miny", F.greatest), ("maxx", F.least), ("maxy", F.least))]))
    many = M.covering_tiles(F.col("box.minx"), F.col("box.miny"), F.col("box.maxx"), F.col("box.maxy"), z, max(cells, 0.0), extent)
    capped = F.when(F.size(many) > options.max_tiles_per_feature, F.raise_error(F.lit("a feature covers more tiles than max_tiles_per_feature"))).otherwise(many)
    rows = rows.withColumn("tile", F.explode(capped)).select(F.col("tile.x").alias("x"), F.col("tile.y").alias("y"), "geom", "fid", "ord", "attrs")
    if tiles is not None:
        rows = rows.join(tiles.select("x", "y").distinct(), ["x", "y"], "left_semi")
    return rows.mapInArrow(_to_commands(options, extent, cells, z), f"x bigint, y bigint, ord bigint, fid bigint, attrs map<string,{S.VALUE}>, code binary")


SLICE = 4096  # features of a tile that are Python objects at a time
BLOCK = 1 << 16  # features of a tile that are arrays at a time


def _assemble(extents: dict[str, int], order: list[str]):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        writers: dict[str, LayerWriter] = {}
        writer = lambda name: writers.setdefault(name, LayerWriter(name, extents[name]))
        place = pc.index_in(table["layer"], pa.array(order))
        rows = pa.table({"place": place, "ord": table["ord"], "code": table["code"].cast(pa.large_binary()), "fid": table["fid"], "attrs": table["attrs"]})
        rows = rows.combine_chunks()  # once: rows taken from many pieces are put together each time
        turn = pc.sort_indices(rows, [(c, "ascending") for c in ("place", "ord", "code")])
        for i in range(0, len(turn), BLOCK):
            block = rows.take(turn[i : i + BLOCK]).combine_chunks()
            attrs = block["attrs"].chunk(0)
            if not attrs.null_count and attrs.offsets[0] == attrs.offsets[-1]:
                places = block["place"].to_numpy()
                for own in np.split(np.arange(len(places)), np.flatnonzero(np.diff(places)) + 1):
                    part = block.slice(own[0], len(own))
                    writer(order[places[own[0]]]).add_plain(part["code"].chunk(0), part["fid"].chunk(0))
                continue
            for j in range(0, len(block), SLICE):
                for r in block.slice(j, SLICE).to_pylist():
                    writer(order[r["place"]]).add_coded(r["code"], r["fid"], {k: plain(v) for k, v in r["attrs"]})
        del rows, turn
        data = b"".join(w.bytes() for w in writers.values())
        x, y = key[0].as_py(), key[1].as_py()
        painted = [n for n in order if n in writers]
        return pa.table({"x": pa.array([x], pa.int64()), "y": pa.array([y], pa.int64()), "data": pa.array([data], pa.binary()), "painted": pa.array([painted], pa.list_(pa.string())), "n_features": pa.array([sum(w.n for w in writers.values())], pa.int64()), "n_keys": pa.array([sum(len(w.keys) for w in writers.values())], pa.int64()), "n_values": pa.array([sum(len(w.values) for w in writers.values())], pa.int64())})

    return run


@dataclass
class TileEncoder:
    """Layers in map order to tiles; the first layer of a name wins."""

    layers: list[LayerSpec]
    options: EncodeOptions = field(default_factory=EncodeOptions)

    def encode(self, z: int, tiles: DataFrame | None = None, held: DataFrame | None = None) -> DataFrame:
        """z, x, y, data, painted, empty, n_features, n_keys, n_values for every tile that
        any layer paints. One shuffle, by tile. With ``tiles`` (x, y) none but those, and
        no layer where ``held`` (x, y, name) has it; that is joined before any encoding."""
        first: dict[str, LayerSpec] = {}
        for layer in self.layers:
            first.setdefault(layer.name, layer)
        parts, order = [], list(first)
        for layer in first.values():
            todo = tiles
            if tiles is not None and held is not None:
                todo = tiles.select("x", "y").join(held.where(F.col("name") == layer.name), ["x", "y"], "left_anti")
            part = encode_features(layer, z, self.options, todo)
            if part is not None:
                parts.append(part.withColumn("layer", F.lit(layer.name)))
        schema = "x bigint, y bigint, data binary, painted array<string>, n_features bigint, n_keys bigint, n_values bigint"
        if not parts:
            out = self.layers[0].source.sparkSession.createDataFrame([], schema)
        else:
            rows = parts[0]
            for p in parts[1:]:
                rows = rows.unionByName(p)
            out = rows.groupBy("x", "y").applyInArrow(_assemble({n: s.extent or self.options.tile_size for n, s in first.items()}, order), schema)
        empty = F.array_except(F.array(*[F.lit(n) for n in order]).cast("array<string>"), "painted")
        return out.select(F.lit(z).alias("z"), "x", "y", "data", "painted", empty.alias("empty"), "n_features", "n_keys", "n_values")


def image_layer(images: DataFrame, name: str) -> DataFrame:
    """``images`` (z, x, y, image) as tiles: one version 2 layer of extent 4096 with one
    raster feature without id."""

    @F.pandas_udf("binary")
    def one(s: pd.Series) -> pd.Series:
        def tile(image):
            w = LayerWriter(name)
            w.add_raster(image, None, {})
            return w.bytes()

        return s.map(tile, na_action="ignore")

    return images.select("z", "x", "y", one("image").alias("data"))
