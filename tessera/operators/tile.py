"""Tiles as bytes: layers, features, dictionaries, checks and edits."""

from __future__ import annotations

import math
import struct

import numpy as np
import pyarrow as pa

from tessera import schema as S
from tessera.functions.codec import inflate
from tessera.operators import geometry as G
from tessera.operators import lines as L
from tessera.operators import wire as W
from tessera.operators.wire import BadTile

#: Field numbers of the format.
TILE_LAYER = 3
LAYER_NAME, LAYER_FEATURE, LAYER_KEY, LAYER_VALUE, LAYER_EXTENT, LAYER_VERSION = 1, 2, 3, 4, 5, 15
FEATURE_ID, FEATURE_TAGS, FEATURE_TYPE, FEATURE_GEOMETRY, FEATURE_RASTER = 1, 2, 3, 4, 5

#: The codes of what a check of a tile can find, in the format's order.
ERRORS = {
    "layer_repeated": "two layers have one name",
    "tile_unknown_field": "the tile has a field of unknown number",
    "tile_versions": "layers have different versions",
    "layer_no_name": "a layer has no name",
    "layer_names": "a layer has several names",
    "layer_no_extent": "a layer has no extent",
    "layer_extents": "a layer has several extents",
    "layer_versions": "a layer has several versions",
    "layer_no_features": "a layer has no features",
    "layer_version": "a layer's version is not 1 or 2",
    "layer_mixed": "a layer has raster and vector features",
    "layer_unknown_field": "a layer has a field of unknown number",
    "values": "a value has several members",
    "value_empty": "a value has no member",
    "value_unknown_field": "a value has a field of unknown number",
    "feature_empty": "a feature has neither geometry nor raster",
    "feature_ids": "a feature has several ids",
    "feature_tags": "a feature has several lists of tags",
    "feature_geometries": "a feature has several geometries",
    "feature_rasters": "a feature has several rasters",
    "feature_both": "a feature has geometry and raster",
    "feature_no_type": "a feature has no geometry type",
    "feature_type": "a feature's geometry type is unknown",
    "feature_unknown_field": "a feature has a field of unknown number",
    "bad_bytes": "the bytes are no message",
}


def typed(v) -> tuple[int, object] | None:
    """(member, value) that an attribute is stored as; None for a null."""
    if v is None:
        return None
    if isinstance(v, bool):
        return S.BOOL, v
    if isinstance(v, int):
        return S.INT, v
    if isinstance(v, float):
        if not math.isnan(v):
            try:
                if struct.unpack("<f", struct.pack("<f", v))[0] == v:
                    return S.FLOAT, v
            except OverflowError:
                pass
        return S.DOUBLE, v
    return S.STRING, str(v)


def _value(tag: int, v) -> bytes:
    if tag == S.STRING:
        return W.blob(1, v.encode())
    if tag == S.FLOAT:
        return W.key(2, 5) + struct.pack("<f", v)
    if tag == S.DOUBLE:
        return W.key(3, 1) + struct.pack("<d", v)
    return W.uint(tag, int(v))


def feature_geometry(gtype: int, cmds: list[int]) -> bytes:
    """A feature's type and geometry fields."""
    return W.uint(FEATURE_TYPE, gtype) + W.packed_uints(FEATURE_GEOMETRY, cmds)


class LayerWriter:
    """A layer's bytes. Keys and values are numbered in the order in which features
    that are kept first use them; a value's type is part of it, and NaN equals NaN."""

    def __init__(self, name: str, extent: int = 4096):
        self.out = [W.uint(LAYER_VERSION, 2), W.blob(LAYER_NAME, name.encode()), W.uint(LAYER_EXTENT, extent)]
        self.keys: dict[str, int] = {}
        self.values: dict[tuple, int] = {}
        self.painted, self.n = False, 0

    def _tags(self, attrs: dict) -> list[int]:
        tags = []
        for k in sorted(attrs):
            t = typed(attrs[k])
            if t is None:
                continue
            if k not in self.keys:
                self.keys[k] = len(self.keys)
                self.out.append(W.blob(LAYER_KEY, k.encode()))
            name = (t[0], "nan") if t[1] != t[1] else t
            if name not in self.values:
                self.values[name] = len(self.values)
                self.out.append(W.blob(LAYER_VALUE, _value(*t)))
            tags += [self.keys[k], self.values[name]]
        return tags

    def add(self, geom: tuple[str, list], fid: int | None, attrs: dict) -> bool:
        """False, and nothing written, for a degenerate geometry."""
        coded = G.encode(geom)
        return coded is not None and self.add_coded(feature_geometry(*coded), fid, attrs)

    def add_coded(self, geometry: bytes, fid: int | None, attrs: dict) -> bool:
        """A feature of feature_geometry()'s bytes."""
        tags = self._tags(attrs)
        f = geometry
        if fid is not None:
            f += W.uint(FEATURE_ID, fid)
        self.out.append(W.blob(LAYER_FEATURE, f + W.packed_uints(FEATURE_TAGS, tags)))
        self.n += 1
        return True

    def add_plain(self, codes: pa.LargeBinaryArray, fids: pa.Int64Array) -> None:
        """Features of feature_geometry()'s bytes without attributes, as add_coded() writes them."""
        at = np.frombuffer(codes.buffers()[1], np.int64)[codes.offset : codes.offset + len(codes) + 1]
        code = np.frombuffer(codes.buffers()[2], np.uint8)
        size = np.diff(at)
        known = fids.is_valid().to_numpy(zero_copy_only=False)
        fid = fids.fill_null(0).to_numpy().view(np.uint64)
        width = L.varint_sizes(fid)
        whole = size + np.where(known, 1 + width, 0)
        head = L.varint_sizes(whole.astype(np.uint64))
        ends = np.cumsum(1 + head + whole)
        begin = ends - whole - head - 1
        out = np.empty(int(ends[-1]), np.uint8)
        out[begin] = LAYER_FEATURE << 3 | 2
        L.put_varints(out, begin + 1, whole.astype(np.uint64), head)
        out[L.ranges(begin + 1 + head, size)] = code[at[0] : at[-1]]
        own = (begin + 1 + head + size)[known]
        out[own] = FEATURE_ID << 3
        L.put_varints(out, own + 1, fid[known], width[known])
        self.out.append(out.tobytes())
        self.n += len(codes)

    def add_raster(self, image: bytes, fid: int | None, attrs: dict) -> None:
        tags = self._tags(attrs)
        f = (W.uint(FEATURE_ID, fid) if fid is not None else b"") + W.blob(FEATURE_RASTER, image) + W.packed_uints(FEATURE_TAGS, tags)
        self.out.append(W.blob(LAYER_FEATURE, f))
        self.n += 1
        self.painted = True

    def bytes(self) -> bytes:
        """The layer as a field of a tile; empty without features."""
        return W.blob(TILE_LAYER, b"".join(self.out)) if self.n else b""


def layers(data: bytes) -> list[bytes]:
    """The layer messages of a tile, compressed or not."""
    out = []
    for number, wire, v in W.fields(inflate(data)):
        if number != TILE_LAYER or wire != 2:
            raise BadTile(f"unknown field {number} in a tile")
        out.append(v)
    return out


def layer_name_version(layer: bytes) -> tuple[str, int]:
    name, version = "", 1
    for number, _, v in W.fields(layer):
        if number == LAYER_NAME:
            name = v.decode("utf-8", "replace")
        elif number == LAYER_VERSION:
            version = v
    return name, version


def _read_value(data: bytes) -> list[tuple[int, object]]:
    out = []
    for number, _, v in W.fields(data):
        if number == S.STRING:
            out.append((number, v.decode("utf-8", "replace")))
        elif number == S.FLOAT:
            out.append((number, W.as_float(v)))
        elif number == S.DOUBLE:
            out.append((number, W.as_double(v)))
        elif number in (S.INT, S.UINT):
            out.append((number, W.signed(v)))
        elif number == S.SINT:
            out.append((number, v >> 1 ^ -(v & 1)))
        elif number == S.BOOL:
            out.append((number, bool(v)))
        else:
            raise BadTile(f"unknown member {number} of a value")
    return out


class Layer:
    """A layer read as a table: header, dictionaries and slices of features."""

    def __init__(self, data: bytes):
        self.name = self.version = self.extent = None
        self.keys: list[str] = []
        self.values: list[tuple[int, object]] = []
        self.features: list[bytes] = []
        self.has_raster = False
        for number, _, v in W.fields(data):
            if number == LAYER_NAME:
                self.name = v.decode("utf-8", "replace")
            elif number == LAYER_FEATURE:
                self.features.append(v)
                self.has_raster |= any(n == FEATURE_RASTER for n, _, _ in W.fields(v))
            elif number == LAYER_KEY:
                self.keys.append(v.decode("utf-8", "replace"))
            elif number == LAYER_VALUE:
                self.values += _read_value(v)
            elif number == LAYER_EXTENT:
                self.extent = v
            elif number == LAYER_VERSION:
                self.version = v
            else:
                raise BadTile(f"unknown field {number} in a layer")
        self.version = 1 if self.version is None else self.version
        if self.name is None:
            raise BadTile("a layer without name")
        if self.extent is None:
            if self.version == 2:
                raise BadTile("a layer without extent")
            self.extent = 4096
        if self.extent == 0:
            raise BadTile("a layer with extent 0")

    def read(self, origin=(0.0, 0.0), scale=(1.0, 1.0), bbox=None, names: set[str] | None = None):
        """Features as dicts; ``names`` are the attributes to read (None: all). Layers of
        a version other than 1 and 2 have none."""
        if self.version not in (1, 2):
            return
        strict = self.version == 2
        for index, data in enumerate(self.features):
            f = {"fid": index, "gtype": None, "cmds": None, "raster": None, "attrs": {}}
            for number, wire, v in W.fields(data):
                if number == FEATURE_ID:
                    f["fid"] = W.signed(v)
                elif number == FEATURE_TAGS:
                    tags = W.packed(v, wire)
                    if len(tags) % 2:
                        raise BadTile("an odd number of tags")
                    for k, t in zip(tags[::2], tags[1::2], strict=True):
                        if k < len(self.keys) and t < len(self.values):
                            if names is None or self.keys[k] in names:
                                f["attrs"][self.keys[k]] = self.values[t]
                        elif strict:
                            raise BadTile("a tag beyond the dictionaries")
                elif number == FEATURE_TYPE:
                    if v not in (1, 2, 3):
                        raise BadTile(f"geometry type {v}")
                    f["gtype"] = v
                elif number in (FEATURE_GEOMETRY, FEATURE_RASTER):
                    if f["cmds"] is not None or f["raster"] is not None:
                        raise BadTile("several geometries or rasters in a feature")
                    if number == FEATURE_GEOMETRY:
                        f["cmds"] = W.packed(v, wire)
                    else:
                        f["raster"] = v
                else:
                    raise BadTile(f"unknown field {number} in a feature")
            if f["raster"] is not None:
                yield f | {"geom": G.EMPTY}
                continue
            if f["cmds"] is None or f["gtype"] is None:
                if strict:
                    raise BadTile("a feature without geometry or type")
                continue
            try:
                geom = G.decode(f["cmds"], f["gtype"], self.version, origin, scale, bbox)
            except BadTile:
                if strict:
                    raise
                continue
            if geom[0] != "empty":
                yield f | {"geom": geom}


# -- checks -------------------------------------------------------------------------


def _feature_errors(data: bytes, found: set[str], counts: dict[str, int]) -> None:
    """Adds to ``found`` and ``counts`` as fields are read, so what stands before broken
    bytes counts. Features count by each type they state and by each raster."""
    n = dict.fromkeys(range(1, 6), 0)
    many = {FEATURE_ID: "feature_ids", FEATURE_TAGS: "feature_tags", FEATURE_GEOMETRY: "feature_geometries", FEATURE_RASTER: "feature_rasters"}
    kinds = {0: "unknown", 1: "point", 2: "line", 3: "polygon"}
    for number, _, v in W.fields(data):
        if number not in n:
            found.add("feature_unknown_field")
            continue
        n[number] += 1
        if number == FEATURE_TYPE:
            if v in kinds:
                counts[kinds[v]] = counts.get(kinds[v], 0) + 1
            else:
                found.add("feature_type")
        elif n[number] > 1:
            found.add(many[number])
        if number == FEATURE_RASTER:
            counts["raster"] = counts.get("raster", 0) + 1
        if n[FEATURE_RASTER] and n[FEATURE_GEOMETRY]:
            found.add("feature_both")
    if not n[FEATURE_RASTER] and not n[FEATURE_GEOMETRY]:
        found.add("feature_empty")
    if n[FEATURE_GEOMETRY] and not n[FEATURE_TYPE]:
        found.add("feature_no_type")


def layer_errors(data: bytes, strict: bool = False) -> tuple[list[str], dict[str, int]]:
    """Codes of ERRORS in their order, and counts of features by type. ``strict``, as
    where tiles are merged, asks for version 1 or 2 too."""
    found: set[str] = set()
    counts: dict[str, int] = {}
    n = dict.fromkeys((LAYER_NAME, LAYER_EXTENT, LAYER_VERSION, LAYER_FEATURE), 0)
    try:
        for number, _, v in W.fields(data):
            if number in n:
                n[number] += 1
            if number == LAYER_FEATURE:
                _feature_errors(v, found, counts)
            elif number == LAYER_VALUE:
                members = [m for m, _, _ in W.fields(v)]
                known = [m for m in members if m <= S.BOOL]
                if len(known) < len(members):
                    found.add("value_unknown_field")
                if not known:
                    found.add("value_empty")
                elif len(known) > 1:
                    found.add("values")
            elif number not in (LAYER_NAME, LAYER_KEY, LAYER_EXTENT, LAYER_VERSION):
                found.add("layer_unknown_field")
    except (BadTile, TypeError, AttributeError):
        found.add("bad_bytes")
    if strict:
        try:
            if layer_name_version(data)[1] not in (1, 2):
                found.add("layer_version")
        except (BadTile, TypeError, AttributeError):
            found.add("bad_bytes")
    for number, none, many in ((LAYER_NAME, "layer_no_name", "layer_names"), (LAYER_EXTENT, "layer_no_extent", "layer_extents"), (LAYER_VERSION, None, "layer_versions"), (LAYER_FEATURE, "layer_no_features", None)):
        if not n[number] and none:
            found.add(none)
        elif n[number] > 1 and many:
            found.add(many)
    return [e for e in ERRORS if e in found], counts


def error_text(codes: list[str]) -> str:
    return "; ".join(ERRORS[c] for c in ERRORS if c in codes)


# -- edits --------------------------------------------------------------------------


def set_version(data: bytes, version: int) -> bytes:
    """Every layer's version field rewritten, all else untouched."""
    out = []
    for layer in layers(data):
        own = [W.uint(LAYER_VERSION, version)]
        for number, wire, v in W.fields(layer):
            if number != LAYER_VERSION:
                own.append(W.uint(number, v) if wire == 0 else W.blob(number, v) if wire == 2 else W.key(number, wire) + v)
        out.append(W.blob(TILE_LAYER, b"".join(own)))
    return b"".join(out)


def clean(data: bytes) -> bytes:
    """Without features that have neither geometry nor raster, and layers they leave empty."""
    out = []
    for layer in layers(data):
        own, kept = [], 0
        for number, wire, v in W.fields(layer):
            if number == LAYER_FEATURE:
                if not any(n in (FEATURE_GEOMETRY, FEATURE_RASTER) for n, _, _ in W.fields(v)):
                    continue
                kept += 1
            own.append(W.uint(number, v) if wire == 0 else W.blob(number, v) if wire == 2 else W.key(number, wire) + v)
        if kept:
            out.append(W.blob(TILE_LAYER, b"".join(own)))
    return b"".join(out)


def _split(layer: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """A layer without its features, and where those begin and how long they are."""
    rest, begin, size, i, n = [], [], [], 0, len(layer)
    mark = LAYER_FEATURE << 3 | 2
    while i < n:
        if layer[i] == mark and i + 1 < n and layer[i + 1] < 128:  # as nearly all are
            start, end = i + 2, i + 2 + layer[i + 1]
        else:
            key, start = W.read_varint(layer, i)
            if key & 7 == 2:
                length, start = W.read_varint(layer, start)
                end = start + length
            elif key & 7 == 0:
                end = W.read_varint(layer, start)[1]
            elif key & 7 in (1, 5):
                end = start + (8 if key & 7 == 1 else 4)
            else:
                raise BadTile(f"wire type {key & 7}")
            if key != mark:
                if end > n:
                    raise BadTile("end of data in a field")
                rest.append(layer[i:end])
                i = end
                continue
        if end > n:
            raise BadTile("end of data in a field")
        begin.append(start)
        size.append(end - start)
        i = end
    return b"".join(rest), np.array(begin, np.int64), np.array(size, np.int64)


def _varints(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below 2**63 that begin at places in bytes, and where they end."""
    value, more = np.zeros(len(at), np.int64), np.ones(len(at), bool)
    at = at.copy()
    for shift in range(0, 63, 7):
        own = np.flatnonzero(more)
        if not len(own):
            return value, at
        if at[own].max() >= len(data):
            raise BadTile("end of data in a varint")
        b = data[at[own]].astype(np.int64)
        value[own] |= (b & 127) << shift
        at[own] += 1
        more[own] = b > 127
    if more.any():
        raise BadTile("varint too long")
    return value, at


def _counted(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> dict[str, int] | None:
    """Counts of the commands of features at places in bytes; None where they are not the
    plain fields of whole bytes that arrays can follow."""
    try:
        at, end = begin, begin + size
        starts, sizes, at, end = [], [], at[size > 0], end[size > 0]
        while len(at):
            key, at = _varints(data, at)
            if not np.isin(key, (FEATURE_ID << 3, FEATURE_TYPE << 3, FEATURE_TAGS << 3 | 2, FEATURE_GEOMETRY << 3 | 2)).all():
                return None
            number, at = _varints(data, at)
            of = key == FEATURE_GEOMETRY << 3 | 2
            starts.append(at[of])
            sizes.append(number[of])
            at = np.where(key & 7 == 2, at + number, at)
            if (at > end).any():
                return None
            at, end = at[at < end], end[at < end]
        start, size = np.concatenate([*starts, begin[:0]]), np.concatenate([*sizes, begin[:0]])
        start, size = start[size > 0], size[size > 0]
        if not len(start):
            return {}
        own = data[L.ranges(start, size)]
        ends = np.cumsum(size)
        stop = own < 128
        if not stop[ends - 1].all():
            return None
        number = np.concatenate([[0], np.cumsum(stop)])  # of the varint that a byte belongs to
        head = np.flatnonzero(np.concatenate([[True], stop[:-1]]))
        v = _varints(own, head)[0]
    except BadTile:
        return None
    i, last = number[ends - size], number[ends]
    n = dict.fromkeys(("n_cmds", "n_move", "n_line", "n_close", "n_degenerate", "n_empty"), 0) | {"n_ints": len(v)}
    ring = np.zeros(len(i), np.int64)
    for _ in range(1 << 10):
        on = i < last
        i, last, ring = i[on], last[on], ring[on]
        if not len(i):
            return n
        which, count = v[i] & 7, v[i] >> 3
        close, move, line = which == 7, which == 1, which == 2
        n["n_cmds"] += len(i)
        n["n_close"] += int(close.sum())
        n["n_degenerate"] += int((ring[close] <= 2).sum())
        n["n_move"] += int(count[move].sum())
        n["n_line"] += int(count[line].sum())
        n["n_empty"] += int((count[move | line] == 0).sum())
        ring = np.where(move, count, np.where(line, ring + count, ring))
        i = i + 1 + np.where(move | line, 2 * np.minimum(count, len(v)), 0)
    return None


def _feature_counts(f: bytes, out: dict[str, int]) -> None:
    for number, wire, v in W.fields(f):
        if number != FEATURE_GEOMETRY:
            continue
        cmds, i, ring = W.packed(v, wire), 0, 0
        out["n_ints"] += len(cmds)
        while i < len(cmds):
            which, count = cmds[i] & 7, cmds[i] >> 3
            i += 1
            out["n_cmds"] += 1
            if which == 7:
                out["n_close"] += 1
                out["n_degenerate"] += ring <= 2
            elif which in (1, 2):
                out["n_move" if which == 1 else "n_line"] += count
                out["n_empty"] += count == 0
                ring = count if which == 1 else ring + count
                i += 2 * count


BLOCK = 1 << 16  # features whose commands are counted at a time


def summary(layer: bytes) -> dict:
    """Counts of a layer's features, dictionaries and commands."""
    head, begin, size = _split(layer)
    t = Layer(head)
    out = {"layer": t.name, "version": t.version, "extent": t.extent, "n_features": len(begin), "n_keys": len(t.keys), "n_values": len(t.values)}
    out |= dict.fromkeys(("n_ints", "n_cmds", "n_move", "n_line", "n_close", "n_degenerate", "n_empty"), 0)
    data = np.frombuffer(layer, np.uint8)
    for i in range(0, len(begin), BLOCK):
        own = begin[i : i + BLOCK], size[i : i + BLOCK]
        counts = _counted(data, *own) if len(own[0]) > 64 else None
        if counts is None:
            for b, n in zip(*(v.tolist() for v in own), strict=True):
                _feature_counts(layer[b : b + n], out)
        else:
            for k, n in counts.items():
                out[k] += n
    return out
