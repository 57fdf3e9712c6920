"""Tiles in files, z/x/y.mvt below a folder, as a data source "mvt" to read and write."""

from __future__ import annotations

import math
import os
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

from tessera.functions.tilemath import HALF

_TESTS = {EqualTo: int.__eq__, GreaterThan: int.__gt__, GreaterThanOrEqual: int.__ge__, LessThan: int.__lt__, LessThanOrEqual: int.__le__}


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the folder of a path or URI."""
    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path.removeprefix("file:")))


def _inside(store: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    return sorted(store.get_file_info(fs.FileSelector(folder, allow_not_found=True)), key=lambda i: i.base_name)


def _numbered(store: fs.FileSystem, folder: str) -> list[int]:
    """Folders with a number for a name."""
    return sorted(int(i.base_name) for i in _inside(store, folder) if i.type == fs.FileType.Directory and re.fullmatch(r"\d+", i.base_name))


def _range(low: float, high: float, z: int) -> tuple[int, int]:
    """First and last tile, of one axis, that a range of distances from the edge meets."""
    side = 2 * HALF / 2**z
    return math.ceil(low / side) - 1, math.floor(high / side)


class _Reader(DataSourceReader):
    def __init__(self, path: str, bbox: str | None):
        self.path = path
        self.bbox = [float(v) for v in bbox.split(",")] if bbox else None
        if self.bbox and len(self.bbox) != 4:
            raise ValueError("bbox is minx,miny,maxx,maxy")
        self.tests: list[tuple[str, type[Filter], object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Conditions on parts of the key choose folders and files."""
        for f in filters:
            key = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if key in ("z", "x", "y") and isinstance(f, (*_TESTS, In, IsNotNull)):
                self.tests.append((key, type(f), getattr(f, "value", None)))
            else:
                yield f

    def _wanted(self, key: str, n: int, z: int) -> bool:
        for name, kind, value in self.tests:
            if name == key and kind is not IsNotNull and not (n in value if kind is In else value is not None and _TESTS[kind](n, int(value))):
                return False
        if self.bbox and key != "z":
            minx, miny, maxx, maxy = self.bbox
            first, last = _range(minx + HALF, maxx + HALF, z) if key == "x" else _range(HALF - maxy, HALF - miny, z)
            return first <= n <= last
        return True

    def partitions(self):
        store, root = _open(self.path)
        return [InputPartition((z, x)) for z in _numbered(store, root) if self._wanted("z", z, z) for x in _numbered(store, f"{root}/{z}") if self._wanted("x", x, z)]

    def read(self, partition):
        if partition is None:  # no folder is wanted
            return
        z, x = partition.value
        store, root = _open(self.path)
        for info in _inside(store, f"{root}/{z}/{x}"):
            m = re.fullmatch(r"(\d+)\.(mvt|pbf)", info.base_name)
            if m and self._wanted("y", int(m[1]), z):
                with store.open_input_stream(info.path, compression=None) as f:
                    yield z, x, int(m[1]), f.read()


@dataclass
class _Written(WriterCommitMessage):
    folder: str


class _Writer(DataSourceWriter):
    """Every attempt of a task writes below a folder of its own, of which none but the
    committed ones are moved to their places."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.staged = f"_staged-{uuid.uuid4().hex}"

    def write(self, rows: Iterator):
        store, root = _open(self.path)
        own = f"{root}/{self.staged}/{uuid.uuid4().hex}"
        made = set()
        for r in rows:
            if r.z is None or r.x is None or r.y is None:
                raise ValueError("a tile without key")
            folder = f"{own}/{r.z}/{r.x}"
            if folder not in made:
                store.create_dir(folder)
                made.add(folder)
            with store.open_output_stream(f"{folder}/{r.y}.mvt", compression=None) as f:
                f.write(r.data or b"")
        return _Written(own)

    def commit(self, messages):
        store, root = _open(self.path)
        if self.overwrite:
            for z in _numbered(store, root):
                store.delete_dir(f"{root}/{z}")
        for own in sorted(m.folder for m in messages if m):
            for z in _numbered(store, own):
                store.create_dir(f"{root}/{z}")
                there = set(_numbered(store, f"{root}/{z}"))
                for x in _numbered(store, f"{own}/{z}"):
                    if x not in there:
                        store.move(f"{own}/{z}/{x}", f"{root}/{z}/{x}")
                        continue
                    for info in _inside(store, f"{own}/{z}/{x}"):
                        place = f"{root}/{z}/{x}/{info.base_name}"
                        for old in (place, place.removesuffix("mvt") + "pbf"):
                            if store.get_file_info(old).type == fs.FileType.File:
                                store.delete_file(old)
                        store.move(info.path, place)
        self.abort(messages)

    def abort(self, messages):
        """What was not committed goes; tiles that were there stay."""
        store, root = _open(self.path)
        if store.get_file_info(f"{root}/{self.staged}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.staged}")


class TileFiles(DataSource):
    """``path`` is a folder, or a URI of a file system that pyarrow knows, which driver and
    executors share. Conditions on z, x and y, and the option ``bbox`` (minx,miny,maxx,maxy
    in map units: tiles that meet it, edges included), choose what is listed and read. A
    write shows at its commit, where ``overwrite`` removes the tiles there were; the commit
    itself moves folder by folder and is not one step. Of tiles with one key, the last one
    moved stays. Null bytes are an empty tile, a null key raises."""

    @classmethod
    def name(cls):
        return "mvt"

    def schema(self):
        return "z int, x bigint, y bigint, data binary"

    def reader(self, schema):
        return _Reader(self.options["path"], self.options.get("bbox"))

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Spark hands conditions to such a source only where this setting allows it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TileFiles)
