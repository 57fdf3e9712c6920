"""Tile and projection arithmetic as Column builders."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6378137.0
HALF = math.pi * RADIUS


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def tiles_across(z) -> Column:
    """2**z as a double, right for every zoom."""
    return F.pow(F.lit(2.0), _c(z).cast("double"))


def tile_bbox(z, x, y) -> Column:
    """struct(minx, miny, maxx, maxy) of a tile in web mercator metres."""
    s = F.lit(2 * HALF) / tiles_across(z)
    x, y = _c(x).cast("double"), _c(y).cast("double")
    return F.struct((x * s - HALF).alias("minx"), (F.lit(HALF) - (y + 1) * s).alias("miny"), ((x + 1) * s - HALF).alias("maxx"), (F.lit(HALF) - y * s).alias("maxy"))


def units_per_cell(width: Column, tile_size) -> Column:
    """Map units of a grid cell; the whole width if there is no grid."""
    size = _c(tile_size)
    return F.when(size == 0, width).otherwise(width / F.when(size == 0, 1).otherwise(size))


def buffered(box: Column, tile_size, buffer_size) -> Column:
    """A box grown by ``buffer_size`` cells on each side; a negative buffer shrinks it to
    its centre at most."""
    w, h = box["maxx"] - box["minx"], box["maxy"] - box["miny"]
    grow = units_per_cell(w, tile_size) * 2.0 * _c(buffer_size)
    nw, nh = F.greatest(w + grow, F.lit(0.0)), F.greatest(h + grow, F.lit(0.0))
    cx, cy = (box["minx"] + box["maxx"]) / 2.0, (box["miny"] + box["maxy"]) / 2.0
    return F.struct((cx - nw / 2.0).alias("minx"), (cy - nh / 2.0).alias("miny"), (cx + nw / 2.0).alias("maxx"), (cy + nh / 2.0).alias("maxy"))


def same_extent(a: Column, b: Column) -> Column:
    return (a["minx"] == b["minx"]) & (a["miny"] == b["miny"]) & (a["maxx"] == b["maxx"]) & (a["maxy"] == b["maxy"])


def intersects(a: Column, b: Column) -> Column:
    """Whether two boxes meet, edges included."""
    return (a["minx"] <= b["maxx"]) & (a["maxx"] >= b["minx"]) & (a["miny"] <= b["maxy"]) & (a["maxy"] >= b["miny"])


def inside(x: Column, y: Column, box: Column) -> Column:
    return x.between(box["minx"], box["maxx"]) & y.between(box["miny"], box["maxy"])


def scale_denominator(width: Column, given=0.0, factor=1.0, metres_per_unit: float = 1.0) -> Column:
    """The given denominator, or that of a 256-pixel tile of this width, times a factor."""
    own = width / 256.0 * metres_per_unit / 0.00028
    return F.when(_c(given) > 0, _c(given)).otherwise(own) * _c(factor)


def visible(denominator: Column, least, most) -> Column:
    """Bounds included."""
    return (denominator >= _c(least)) & (denominator <= _c(most))


def lonlat_to_mercator(lon: Column, lat: Column) -> Column:
    """struct(x, y), null where |lat| >= 90."""
    ok = F.abs(lat) < 90.0
    y = F.log(F.tan(F.lit(math.pi / 4) + F.radians(F.when(ok, lat)) / 2.0)) * RADIUS
    return F.when(ok, F.struct((lon * (HALF / 180.0)).alias("x"), y.alias("y")))


def mercator_to_lonlat(x: Column, y: Column) -> Column:
    """struct(x, y) in degrees."""
    lat = F.degrees(F.atan(F.exp(y / RADIUS)) * 2.0 - math.pi / 2)
    return F.struct((x * (180.0 / HALF)).alias("x"), lat.alias("y"))


def source_box(box: Column, srs: int) -> Column:
    """A box of the map in the units of a source. Both axes keep their order, so two corners
    are enough."""
    if srs == 3857:
        return box
    low, high = mercator_to_lonlat(box["minx"], box["miny"]), mercator_to_lonlat(box["maxx"], box["maxy"])
    return F.struct(low["x"].alias("minx"), low["y"].alias("miny"), high["x"].alias("maxx"), high["y"].alias("maxy"))


def query_extent(layer: Column, box: Column, srs: int) -> Column:
    """What of a layer's box (source units) a box of the map asks for; null if nothing."""
    own = source_box(box, srs)
    shared = F.struct(*[pick(layer[n], own[n]).alias(n) for n, pick in (("minx", F.greatest), ("miny", F.greatest), ("maxx", F.least), ("maxy", F.least))])
    return F.when(intersects(layer, own), shared)


def query_resolution(box: Column, extent, srs: int) -> Column:
    """struct(x, y): grid cells to a unit of the source, over an unbuffered box; a side
    without length counts as one unit."""
    own = source_box(box, srs)
    per = lambda side: _c(extent) / F.when(side > 0, side).otherwise(F.lit(1.0))
    return F.struct(per(own["maxx"] - own["minx"]).alias("x"), per(own["maxy"] - own["miny"]).alias("y"))


def lonlat_to_tile(lon: Column, lat: Column, z) -> Column:
    """struct(x, y): the place in tiles at a zoom, as fractions."""
    s = F.sin(F.radians(lat))
    return F.struct((tiles_across(z) * (lon / 360.0 + 0.5)).alias("x"), (tiles_across(z) * (F.lit(0.5) - F.log((F.lit(1.0) + s) / (F.lit(1.0) - s)) * 0.25 / math.pi)).alias("y"))


def decode_origin(z, x, y, extent) -> Column:
    """struct(tile_x, tile_y, scale) that turns grid values into map units."""
    res = F.lit(2 * HALF) / tiles_across(z)
    return F.struct((_c(x) * res - HALF).alias("tile_x"), (F.lit(HALF) - _c(y) * res).alias("tile_y"), (_c(extent) / res).alias("scale"))


def to_grid(x: Column, y: Column, box: Column, extent, offset_x=0, offset_y=0) -> Column:
    """struct(x, y) on the tile's grid, y down, halves away from zero; null outside
    +-2**62."""
    px = F.round((x - box["minx"]) * _c(extent) / (box["maxx"] - box["minx"]) - _c(offset_x))
    py = F.round((box["maxy"] - y) * _c(extent) / (box["maxy"] - box["miny"]) - _c(offset_y))
    ok = (F.abs(px) < 2.0**62) & (F.abs(py) < 2.0**62)
    return F.when(ok, F.struct(F.when(ok, px).cast("long").alias("x"), F.when(ok, py).cast("long").alias("y")))


def covering_tiles(minx: Column, miny: Column, maxx: Column, maxy: Column, z: int, buffer_cells: float = 0.0, extent: int = 4096) -> Column:
    """array of struct(x, y): every tile of a zoom whose buffered extent meets the box,
    edges included."""
    n, s = 2**z, 2 * HALF / 2**z
    pad = buffer_cells * s / extent
    low = lambda v: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.ceil(v / s).cast("long") - 1))
    high = lambda v: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(v / s).cast("long")))
    xs = F.sequence(low(minx - pad + HALF), high(maxx + pad + HALF))
    ys = F.sequence(low(F.lit(HALF) - maxy - pad), high(F.lit(HALF) - miny + pad))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("x"), y.alias("y")))))


def zoom_of_bbox(minx: Column, miny: Column, maxx: Column, maxy: Column, deepest: int = 31) -> Column:
    """The deepest zoom at which one tile holds both corners' (integer) tile keys."""
    differ = (minx.bitwiseXOR(maxx)).bitwiseOR(miny.bitwiseXOR(maxy))
    return F.lit(deepest) - F.when(differ == 0, 0).otherwise(F.floor(F.log2(F.greatest(differ, F.lit(1)).cast("double"))) + 1).cast("int")
