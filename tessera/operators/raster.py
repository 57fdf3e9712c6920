"""Rasters to tiles and windows of them.

An image is an array of rows and columns, with a third axis for several bands. As bytes it is
PNG (8 bits with 1, 3 or 4 bands, 16 bits with 1) or NumPy's own format (all types)."""

from __future__ import annotations

import io
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import tilemath as M
from tessera.operators import encode as E
from tessera.operators.tile import LayerWriter

#: Names of pixel types, with NumPy's.
TYPES = {"rgba8": "u1", "gray8": "u1", "gray8s": "i1", "gray16": "u2", "gray16s": "i2", "gray32": "u4", "gray32s": "i4", "gray32f": "f4", "gray64": "u8", "gray64s": "i8", "gray64f": "f8"}
#: PNG's signature, and bands by colour type.
_PNG, _BANDS = b"\x89PNG\r\n\x1a\n", {0: 1, 2: 3, 6: 4}
METHODS = ("near", "bilinear")


def to_png(image: np.ndarray) -> bytes:
    bands = image.shape[2] if image.ndim == 3 else 1
    if image.dtype not in (np.uint8, np.uint16) or bands not in _BANDS.values() or image.dtype == np.uint16 and bands > 1:
        raise ValueError(f"no PNG of {bands} bands of {image.dtype}")
    colour = next(c for c, b in _BANDS.items() if b == bands)
    height, width = image.shape[:2]
    rows = np.ascontiguousarray(image.astype(image.dtype.newbyteorder(">"))).view(np.uint8).reshape(height, -1)
    raw = np.hstack([np.zeros((height, 1), np.uint8), rows]).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return _PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8 * image.dtype.itemsize, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def _png_header(data: bytes) -> tuple[int, int, int, int]:
    """Width, height, bytes of a sample and bands."""
    width, height, depth, colour, _, _, laced = struct.unpack(">IIBBBBB", data[16:29])
    if depth not in (8, 16) or colour not in _BANDS or laced:
        raise ValueError("no PNG of 8 or 16 bits without palette and interlacing")
    return width, height, depth // 8, _BANDS[colour]


def _unfiltered(rows: np.ndarray, kinds: np.ndarray, step: int) -> np.ndarray:
    """PNG's filters undone, row by row: each byte was stored less one foretold from its
    left, upper and upper left neighbours."""
    before = np.zeros(rows.shape[1], np.uint8)
    for row, kind in zip(rows, kinds, strict=True):
        if kind == 1:
            for b in range(step):
                row[b::step] = np.cumsum(row[b::step], dtype=np.uint8)
        elif kind == 2:
            row += before
        elif kind in (3, 4):
            left, corner = [0] * step, [0] * step
            for i, (v, up) in enumerate(zip(row.tolist(), before.tolist(), strict=True)):
                b = i % step
                a, c = left[b], corner[b]
                if kind == 3:
                    guess = (a + up) // 2
                else:
                    p = a + up - c
                    guess = min((abs(p - a), 0, a), (abs(p - up), 1, up), (abs(p - c), 2, c))[2]
                row[i] = left[b] = (v + guess) & 255
                corner[b] = up
        elif kind:
            raise ValueError(f"no PNG filter {kind}")
        before = row
    return rows


def from_bytes(data: bytes) -> np.ndarray:
    if not data.startswith(_PNG):
        return np.load(io.BytesIO(data), allow_pickle=False)
    width, height, size, bands = _png_header(data)
    at, body = 8, []
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            body.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, -1)
    flat = _unfiltered(raw[:, 1:].copy(), raw[:, 0], size * bands)
    image = np.ascontiguousarray(flat).view(">u2" if size == 2 else "u1").astype(f"u{size}")
    return image.reshape((height, width, bands) if bands > 1 else (height, width))


def to_bytes(image: np.ndarray, form: str = "png") -> bytes:
    if form == "png":
        return to_png(image)
    out = io.BytesIO()
    np.save(out, image, allow_pickle=False)
    return out.getvalue()


def _weighed(image: np.ndarray, back: bool = False) -> np.ndarray:
    """Colours of four bands times (or by) their alpha, so that what is clear has none."""
    if image.ndim < 3 or image.shape[2] != 4:
        return image
    alpha = image[..., 3:] / 255.0
    colour = np.divide(image[..., :3], alpha, out=np.zeros(image[..., :3].shape), where=alpha > 0) if back else image[..., :3] * alpha
    return np.concatenate([colour, image[..., 3:]], axis=2)


def sample(image: np.ndarray, rows: np.ndarray, columns: np.ndarray, method: str = "near") -> np.ndarray:
    """Pixels at places (in pixels from the upper left corner, centres at halves); places
    outside take the nearest edge's."""
    if method == "near":
        r, c = (np.clip(np.floor(v), 0, n - 1).astype(np.int64) for v, n in ((rows, image.shape[0]), (columns, image.shape[1])))
        return image[r][:, c]
    if method != "bilinear":
        raise ValueError(f"no method {method}; {METHODS}")
    work = _weighed(image.astype(np.float64))
    for axis, places in ((0, rows), (1, columns)):
        n = image.shape[axis]
        at = np.clip(places - 0.5, 0, n - 1)
        low = np.floor(at).astype(np.int64)
        share = (at - low).reshape([-1 if i == axis else 1 for i in range(work.ndim)])
        work = work.take(low, axis) * (1 - share) + work.take(np.minimum(low + 1, n - 1), axis) * share
    work = _weighed(work, back=True)
    return work.astype(image.dtype) if image.dtype.kind == "f" else np.clip(np.floor(work + 0.5), np.iinfo(image.dtype).min, np.iinfo(image.dtype).max).astype(image.dtype)


def _placed(low: float, high: float) -> tuple[int, int]:
    return math.floor(low + 0.5), math.floor(high + 0.5)


def _latitude(y: np.ndarray) -> np.ndarray:
    return np.degrees(2 * np.arctan(np.exp(y / M.RADIUS)) - math.pi / 2)


def paint(image: np.ndarray, box, srs: int, z: int, x: int, y: int, size: int, method: str) -> np.ndarray | None:
    """A canvas of size x size pixels of a tile, clear but where the image's ``box`` lies;
    None if that is not a pixel."""
    side = 2 * M.HALF / 2**z
    left, top, per = x * side - M.HALF, M.HALF - y * side, size / side
    world = box
    if srs == 4326:
        radians = [math.radians(min(max(v, -89.999999), 89.999999)) for v in (box[1], box[3])]
        bottom, upper = (math.log(math.tan(math.pi / 4 + r / 2)) * M.RADIUS for r in radians)
        world = (box[0] * M.HALF / 180, bottom, box[2] * M.HALF / 180, upper)
    ends = (world[0] - left) * per, (world[2] - left) * per, (top - world[3]) * per, (top - world[1]) * per
    (x0, x1), (y0, y1) = _placed(*ends[:2]), _placed(*ends[2:])
    cx, cy = np.arange(max(x0, 0), min(x1, size)), np.arange(max(y0, 0), min(y1, size))
    if not len(cx) or not len(cy):
        return None
    height, width = image.shape[:2]
    columns = (cx - x0 + 0.5) * width / (ends[1] - ends[0])
    if srs == 4326:
        rows = (box[3] - _latitude(top - (cy + 0.5) / per)) * height / (box[3] - box[1])
    else:
        rows = (cy - y0 + 0.5) * height / (ends[3] - ends[2])
    canvas = np.zeros((size, size, *image.shape[2:]), image.dtype)
    canvas[cy[0] : cy[-1] + 1, cx[0] : cx[-1] + 1] = sample(image, rows, columns, method)
    return canvas


def encode_rasters(rasters: DataFrame, name: str, z: int, srs: int = 3857, tile_size: int = 4096, declared_extent: int | None = None, method: str = "near", form: str = "png", max_tiles: int = 1 << 16) -> DataFrame:
    """``rasters`` (fid, minx, miny, maxx, maxy in units of ``srs``, width, height, type one
    of TYPES, pixels: row by row from the upper left corner, little-endian) as tiles (z, x,
    y, data) of one layer with one raster each: that of the least fid, as a layer shows none
    but its first feature. A source that declares an extent is shown at 256, other ones at
    ``tile_size``. Other columns are attributes.

    Which raster a tile shows is found on keys alone; pixels are shuffled once, and one
    raster is held at a time. Rasters with a null in their place, without a pixel or without
    extent are left out; repeated rows count once; pixels of another length raise."""
    if method not in METHODS or srs not in (3857, 4326):
        raise ValueError(f"methods are {METHODS}; srs are 3857 and 4326")
    size = 256 if declared_extent else tile_size
    box = ("minx", "miny", "maxx", "maxy")
    own = ["fid", *box, "width", "height", "type", "pixels"]
    other = [c for c in rasters.columns if c not in own]
    kinds = {"fid": "long", "width": "int", "height": "int", "type": "string", "pixels": "binary"}
    rows = rasters.select(*[F.col(c).cast(kinds.get(c, "double")).alias(c) for c in own], E.attributes(rasters, other).alias("attrs"))
    rows = rows.where("minx < maxx and miny < maxy and width > 0 and height > 0 and pixels is not null and type is not null")
    key = F.sha2(F.to_json(F.struct("fid", *box, "width", "height", "type", F.sha2("pixels", 256).alias("sha"), F.sort_array(F.map_entries("attrs")).alias("a"))), 256)
    rows = rows.withColumn("key", key)
    world = [F.col(c) for c in box]
    if srs == 4326:
        at = lambda lon, lat: M.lonlat_to_mercator(F.col(lon), F.greatest(F.least(F.col(lat), F.lit(89.999999)), F.lit(-89.999999)))
        low, high = at("minx", "miny"), at("maxx", "maxy")
        world = [low["x"], low["y"], high["x"], high["y"]]
    tiles = M.covering_tiles(*world, z)
    capped = F.when(F.size(tiles) > max_tiles, F.raise_error(F.lit("a raster covers more tiles than max_tiles"))).otherwise(tiles)
    side = 2 * M.HALF / 2**z
    met = rows.select("key", "fid", F.struct(*[w.alias(n) for n, w in zip(box, world, strict=True)]).alias("w"), F.explode(capped).alias("t"))
    pixel = lambda v: F.least(F.greatest(F.floor(v * (size / side) + 0.5), F.lit(0)), F.lit(size))
    left, top = F.col("t.x") * side - M.HALF, F.lit(M.HALF) - F.col("t.y") * side
    met = met.where((pixel(F.col("w.maxx") - left) > pixel(F.col("w.minx") - left)) & (pixel(top - F.col("w.miny")) > pixel(top - F.col("w.maxy"))))
    shown = met.groupBy("t").agg(F.min(F.struct(F.col("fid").isNull().alias("none"), "fid", "key")).alias("first"))
    of = shown.groupBy(F.col("first.key").alias("key")).agg(F.collect_list("t").alias("tiles"))  # at most max_tiles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                r = batch.slice(i, 1).to_pylist()[0]
                dtype, bands = np.dtype(TYPES[r["type"]]).newbyteorder("<"), 4 if r["type"] == "rgba8" else 1
                shape = (r["height"], r["width"], bands) if bands > 1 else (r["height"], r["width"])
                if len(r["pixels"]) != math.prod(shape) * dtype.itemsize:
                    raise ValueError("pixels are not of the raster's size")
                image = np.frombuffer(r["pixels"], dtype).reshape(shape).astype(dtype.newbyteorder("="))
                attrs = {k: E.plain(v) for k, v in r["attrs"]}
                for t in r["tiles"]:
                    canvas = paint(image, [r[c] for c in box], srs, z, t["x"], t["y"], size, method)
                    if canvas is not None:
                        w = LayerWriter(name, size)
                        w.add_raster(to_bytes(canvas, form), r["fid"], attrs)
                        yield pa.RecordBatch.from_arrays([pa.array([z], pa.int32()), pa.array([t["x"]], pa.int64()), pa.array([t["y"]], pa.int64()), pa.array([w.bytes()], pa.binary())], names=["z", "x", "y", "data"])

    return rows.dropDuplicates(["key"]).join(of, "key").select(*[c for c in own], "attrs", "tiles").mapInArrow(run, "z int, x bigint, y bigint, data binary")


def window(tile: Column, query: Column, width: Column, height: Column) -> Column:
    """struct(x_off, y_off, width, height, box) of the least window of an image over ``tile``
    that holds what ``query`` shares with it, at least a pixel, and that window's box; null
    where they share nothing."""
    shared = {"minx": F.greatest(tile["minx"], query["minx"]), "miny": F.greatest(tile["miny"], query["miny"]), "maxx": F.least(tile["maxx"], query["maxx"]), "maxy": F.least(tile["maxy"], query["maxy"])}
    px, py = (tile["maxx"] - tile["minx"]) / width, (tile["maxy"] - tile["miny"]) / height
    x0, x1 = (shared["minx"] - tile["minx"]) / px, (shared["maxx"] - tile["minx"]) / px
    y0, y1 = (tile["maxy"] - shared["maxy"]) / py, (tile["maxy"] - shared["miny"]) / py
    least = 5 * float(np.finfo(np.float64).eps)
    first = lambda v, n: F.greatest(F.least(F.floor(v), n - 1), F.lit(0)).cast("int")
    count = lambda v, w, n: F.greatest(F.least(F.ceil(w), n) - first(v, n), F.lit(1)).cast("int")
    xo, yo, w, h = first(x0, width), first(y0, height), count(x0, x1, width), count(y0, y1, height)
    box = F.struct((tile["minx"] + xo * px).alias("minx"), (tile["maxy"] - (yo + h) * py).alias("miny"), (tile["minx"] + (xo + w) * px).alias("maxx"), (tile["maxy"] - yo * py).alias("maxy"))
    found = F.struct(xo.alias("x_off"), yo.alias("y_off"), w.alias("width"), h.alias("height"), box.alias("box"))
    return F.when((width > 0) & (height > 0) & (x1 - x0 > least) & (y1 - y0 > least), found)


def image_size(data: Column) -> Column:
    """struct(width, height) of an image's bytes; nulls of a null."""

    def one(b):
        if b is None:
            return None, None
        if b.startswith(_PNG):
            return _png_header(b)[:2]
        return np.load(io.BytesIO(b), allow_pickle=False).shape[1::-1]

    @F.pandas_udf("width int, height int")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(b) for b in s], columns=["width", "height"], dtype="Int32")

    return run(data)


def crop(data: Column, window: Column) -> Column:
    """The ``window`` of an image's bytes, in their format."""

    def one(b, x, y, w, h):
        image = from_bytes(b)[y : y + h, x : x + w]
        return to_bytes(image, "png" if b.startswith(_PNG) else "npy")

    @F.pandas_udf("binary")
    def run(s: pd.Series, x: pd.Series, y: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([None if b is None or at[0] != at[0] else one(b, *map(int, at)) for b, *at in zip(s, x, y, w, h, strict=True)], dtype=object)

    return run(data, *[window[c] for c in ("x_off", "y_off", "width", "height")])


def read_rasters(found: DataFrame, query: tuple[float, float, float, float], envelope: Column | None = None) -> DataFrame:
    """Of decoded features (z, x, y, raster) those whose raster meets ``query`` (map units):
    the window of the image that holds it, and that window's box. Images lie over the tile,
    or over ``envelope``, a box, if given."""
    tile = M.tile_bbox(F.col("z"), F.col("x"), F.col("y")) if envelope is None else envelope
    box = F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("minx", "miny", "maxx", "maxy"), query, strict=True)])
    sized = found.where("raster is not null").withColumn("_size", image_size(F.col("raster")))
    cut = sized.withColumn("window", window(tile, box, F.col("_size.width"), F.col("_size.height"))).where("window is not null")
    return cut.withColumn("raster", crop(F.col("raster"), F.col("window"))).drop("_size")
