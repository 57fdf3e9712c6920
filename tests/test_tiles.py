import math
import os
import random

import numpy as np
import pytest
from conftest import oracle, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import codec
from tessera.functions import tilemath as M
from tessera.operators import combine, decode, overlay
from tessera.operators import geometry as G
from tessera.operators import raster as R
from tessera.operators import tile as T
from tessera.operators import wire as W
from tessera.operators.encode import EncodeOptions, LayerSpec, TileEncoder, geometry, point
from tessera.operators.wire import BadTile
from tessera.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_sql(spark, name):
    found = QUERIES[name](spark, SF)
    rows = found.collect()
    assert rows
    if name in SQL:
        want = oracle(SF).sql(SQL[name])
        assert rows_of(found.columns, [tuple(r) for r in rows]) == rows_of(want.columns, want.fetchall())


def test_commands_of_points_lines_and_rings():
    assert G.encode(("point", [[[(25, 17)]]])) == (1, [9, 50, 34])
    assert G.encode(("multipoint", [[[(5, 7), (3, 2)]]])) == (1, [17, 10, 14, 3, 9])
    assert G.encode(("linestring", [[[(2, 2), (2, 2), (2, 10), (10, 10)]]])) == (2, [9, 4, 4, 18, 0, 16, 16, 0])
    assert G.encode(("polygon", [[[(3, 6), (8, 12), (20, 34), (3, 6)]]])) == (3, [9, 6, 12, 18, 10, 12, 24, 44, 15])
    assert G.encode(("linestring", [[[(1, 1), (1, 1)]]])) is None
    assert G.encode(("polygon", [[[(1, 1), (2, 2), (1, 1)]]])) is None
    with pytest.raises(ValueError):
        G.encode(("geometrycollection", []))


@given(st.lists(st.tuples(st.integers(-5000, 5000), st.integers(-5000, 5000)), min_size=2, max_size=20))
@settings(max_examples=60, deadline=None)
def test_lines_come_back(points):
    own = G.distinct(points)
    coded = G.encode(("linestring", [[points]]))
    if len(own) < 2:
        assert coded is None
    else:
        assert G.decode(coded[1], 2) == ("linestring", [[own]])


@pytest.mark.parametrize(("cmds", "v1"), [([9, 2, 2, 9, 4, 4, 10, 6, 6], ("linestring", [[[(3, 3), (6, 6)]]])), ([9, 2, 2, 10, 4, 4, 9, 6, 6], ("linestring", [[[(1, 1), (3, 3)]]]))])
def test_version_1_forgives_what_version_2_does_not(cmds, v1):
    assert G.decode(cmds, 2, 1) == v1
    with pytest.raises(BadTile):
        G.decode(cmds, 2, 2)


@pytest.mark.parametrize("cmds", [[10, 2, 2], [9, 2], [17, 2, 2, 4, 4, 10, 2, 2], [9, 2, 2, 15], [12, 1]])
def test_bad_lines_raise_in_both_versions(cmds):
    for version in (1, 2):
        with pytest.raises(BadTile):
            G.decode(cmds, 2, version)


def test_rings_group_by_winding():
    e = G.Encoder()
    e.polygon([[(0, 0), (10, 0), (10, 10), (0, 10)], [(2, 2), (2, 4), (4, 4), (4, 2)]])
    e.polygon([[(20, 0), (30, 0), (30, 10), (20, 10)]])
    kind, parts = G.decode(e.out, 3)
    assert kind == "multipolygon" and [len(p) for p in parts] == [2, 1]
    kind, parts = G.decode(e.out, 3, bbox=(15, -5, 40, 20))
    assert kind == "polygon" and len(parts[0]) == 1
    back = G.Encoder()
    back.ring([(0, 0), (0, 10), (10, 10), (10, 0)])
    with pytest.raises(BadTile):
        G.decode(back.out, 3, 2)
    assert G.decode(back.out, 3, 1)[0] == "polygon"


def test_clip_and_simplify():
    assert G.clip_line([(-5, 5), (15, 5)], (0, 0, 10, 10)) == [[(0, 5), (10, 5)]]
    assert len(G.clip_line([(-5, 1), (5, 1), (15, 1), (15, 3), (-5, 3)], (0, 0, 10, 10))) == 2
    ring = G.clip_ring([(-5, -5), (5, -5), (5, 5), (-5, 5), (-5, -5)], (0, 0, 10, 10))
    assert abs(G.area2(ring)) == 50
    assert G.clip(("polygon", [[[(0, 0), (1, 0), (1, 1), (0, 0)]]]), (0, 0, 9, 9), area_threshold=2) == G.EMPTY
    assert G.douglas_peucker([(0, 0), (5, 1), (10, 0)], 1) == [(0, 0), (10, 0)]
    assert G.douglas_peucker([(0, 0), (5, 2), (10, 0)], 1) == [(0, 0), (5, 2), (10, 0)]


def test_layer_dictionaries_are_typed_and_sized():
    w = T.LayerWriter("l")
    p = ("point", [[[(1, 1)]]])
    assert w.add(p, 1, {"a": 1, "b": 1.0, "c": True, "d": None, "e": math.nan})
    assert w.add(p, 2, {"a": 1, "e": math.nan})
    assert not w.add(("linestring", [[[(1, 1)]]]), 3, {"zz": 1})
    t = T.Layer(T.layers(w.bytes())[0])
    assert t.keys == ["a", "b", "c", "e"] and len(t.values) == 4 and t.version == 2
    assert [f["fid"] for f in t.read()] == [1, 2]
    assert [f["attrs"] for f in t.read(names=set())] == [{}, {}]


def test_truncated_tiles_raise_or_read():
    w = T.LayerWriter("l")
    w.add(("linestring", [[[(1, 1), (5, 5)]]]), 1, {"a": "b"})
    data = w.bytes()
    for n in range(len(data)):
        try:
            for layer in T.layers(data[:n]):
                list(T.Layer(layer).read())
        except BadTile:
            pass


def test_checks_name_what_is_wrong():
    feature = W.blob(2, W.uint(3, 9) + W.blob(4, b"\x09\x02\x02"))
    codes, counts = T.layer_errors(W.uint(15, 3) + feature + W.blob(4, b""), strict=True)
    assert codes == ["layer_no_name", "layer_no_extent", "layer_version", "value_empty", "feature_type"]
    assert counts == {}
    none = ["layer_no_name", "layer_no_extent", "layer_no_features"]
    assert T.layer_errors(b"\xff")[0] == [*none, "bad_bytes"]
    assert T.layer_errors(W.uint(15, 3))[0] == none  # versions are asked for where tiles are merged
    head = W.blob(1, b"a") + W.uint(5, 4096)
    one = lambda f: T.layer_errors(head + W.blob(2, f))
    point = W.uint(3, 1) + W.blob(4, b"\x09\x02\x02")
    assert one(point) == ([], {"point": 1})  # version 1 needs no version
    assert one(W.uint(3, 0) + W.blob(4, b"\x09")) == ([], {"unknown": 1})
    assert one(W.blob(4, b"\x09")) == (["feature_no_type"], {})
    assert one(point + W.blob(5, b"x")) == (["feature_both"], {"point": 1, "raster": 1})
    assert one(W.blob(5, b"x") + W.blob(5, b"y")) == (["feature_rasters"], {"raster": 2})
    assert one(W.uint(1, 1) + W.uint(1, 2) + W.blob(2, b"") + W.blob(2, b"")) == (["feature_empty", "feature_ids", "feature_tags"], {})
    assert one(point + W.uint(9, 1)) == (["feature_unknown_field"], {"point": 1})
    assert T.layer_errors(head + head + W.blob(4, W.uint(4, 1) + W.uint(4, 1)) + W.blob(4, W.uint(9, 1)) + W.uint(8, 1))[0] == ["layer_names", "layer_extents", "layer_no_features", "layer_unknown_field", "values", "value_empty", "value_unknown_field"]
    assert list(T.ERRORS).index("layer_repeated") == 0 and len(T.ERRORS) == 25


def test_rings_that_no_version_forgives():
    for version in (1, 2):
        for cmds in ([15], [9, 0, 0, 18, 20, 0, 0, 20, 15, 15], [9, 0, 0, 10, 20, 0], [9, 0, 0, 18, 20, 0, 0, 20, 15, 10, 2, 2]):
            with pytest.raises(BadTile):
                G.decode(cmds, 3, version)
    assert G.decode([9, 0, 0, 15], 3, 1) == G.EMPTY
    flat = [9, 0, 0, 26, 20, 0, 20, 0, 19, 0, 15]  # a first ring without area is not clockwise
    assert G.decode(flat, 3, 2)[0] == "polygon"


def inside(polygons, x, y):
    return sum(sum(overlay._holds(r, x, y) for r in p) % 2 for p in polygons)


def winding(rings, x, y):
    """Signed crossings of a ray to the right."""
    n = 0
    for r in rings:
        for (ax, ay), (bx, by) in zip(r, r[1:], strict=False):
            if (ay > y) != (by > y) and x < ax + (y - ay) / (by - ay) * (bx - ax):
                n += 1 if by > ay else -1
    return n


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("fill", ["even_odd", "non_zero", "positive", "negative"])
def test_union_by_brute_force(fill, seed):
    """Rings on even points; odd ones are never on an edge's end. Points near a crossing
    that was moved to a whole point are left out."""
    rng = np.random.default_rng(seed)
    rings = []
    for _ in range(int(rng.integers(1, 4))):
        r = [tuple(map(int, p)) for p in rng.integers(0, 400, (int(rng.integers(3, 9)), 2)) * 2]
        rings.append([*r, r[0]])
    found = overlay.union(rings, fill)
    wrong = tried = 0
    for x, y in rng.uniform(0, 800, (400, 2)).tolist():
        near = min(abs((bx - ax) * (ay - y) - (ax - x) * (by - ay)) / max(1e-9, math.hypot(bx - ax, by - ay)) for r in rings for (ax, ay), (bx, by) in zip(r, r[1:], strict=False))
        if near > 1.5:
            tried += 1
            wrong += inside(found, x, y) != int(overlay.INSIDE[fill](np.array(winding(rings, x, y))))
    assert tried > 100 and wrong == 0
    for p in found:
        assert overlay.area2(p[0]) > 0 and all(overlay.area2(h) < 0 for h in p[1:])
        assert all(len(set(r)) == len(r) - 1 for r in p)
    flat = [r for p in found for r in p]
    a, b = (np.array([x for r in flat for x in s(r)], np.int64).reshape(-1, 2) for s in (lambda r: r[:-1], lambda r: r[1:]))
    assert not flat or not any(overlay._cross(np.array(b[i] - a[i]), np.array(c) - a[i]) for i, cs in overlay._cuts(a, b).items() for c in cs)


def test_polygons_are_cut_apart_and_joined():
    box = (0, 0, 10, 10)
    c_shape = [(12, 8), (12, 6), (4, 6), (4, 4), (12, 4), (12, 2), (2, 2), (2, 8), (12, 8)][::-1]
    prongs = [(-2, 0), (20, 0), (20, 2), (-1, 2), (-1, 6), (20, 6), (20, 8), (-2, 8), (-2, 0)]
    assert len(G.clip(("polygon", [[c_shape]]), box)[1]) == 1
    kind, two = G.clip(("polygon", [[prongs]]), box)
    assert sorted(sum(map(G.area2, p)) / 2 for p in two) == [20, 20]
    square = lambda x, y, d: [(x, y), (x + d, y), (x + d, y + d), (x, y + d), (x, y)]
    pair = ("multipolygon", [[square(0, 0, 4)], [square(2, 2, 4)]])
    assert len(G.clip(pair, box)[1]) == 2
    (joined,) = G.clip(pair, box, union=True)[1]
    assert G.area2(joined[0]) / 2 == 28
    crossed = G.clip(pair, box, union=True, fill="even_odd")[1]
    assert sum(G.area2(r) for p in crossed for r in p) / 2 == 24
    assert G.clip(pair, box, fill="negative") == G.EMPTY
    outside_with_hole = ("polygon", [[square(20, 20, 5), square(2, 2, 4)]])
    assert G.clip(outside_with_hole, box) == G.EMPTY
    assert G.clip(outside_with_hole, box, process_all_rings=True) == G.EMPTY  # a hole alone winds backwards
    assert sum(G.area2(r) for p in G.clip(outside_with_hole, box, process_all_rings=True, fill="even_odd")[1] for r in p) / 2 == 16


def test_edges_buffers_and_scale(spark):
    one = spark.range(1).select(F.lit(0.0).alias("x"))
    t = M.covering_tiles(F.col("x"), F.col("x"), F.col("x"), F.col("x"), 1)
    assert len(one.select(t.alias("t")).first().t) == 4
    src = one.select(point(F.col("x"), F.col("x")).alias("geom"), F.lit(0).alias("fid"))
    assert TileEncoder([LayerSpec("a", src)]).encode(1).count() == 4
    assert TileEncoder([LayerSpec("a", src, max_scale=1000.0)]).encode(1).count() == 0
    with pytest.raises(ValueError):
        TileEncoder([LayerSpec("a", src, srs=2154)]).encode(1)
    with pytest.raises(ValueError):
        EncodeOptions(tile_size=-1)


def test_polygons_to_tiles_and_back(spark):
    q = M.HALF / 2
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((-q, -q), (q, -q), (q, q), (-q, q), (-q, -q))])
    src = spark.range(1).select(geometry("polygon", F.array(F.array(ring))).alias("geom"), F.lit(7).alias("fid"), F.lit("p").alias("name"))
    tiles = TileEncoder([LayerSpec("a", src)]).encode(1)
    rows = decode.features(tiles).collect()
    assert len(rows) == 4 and all(r.gtype == 3 and r.fid == 7 for r in rows)
    assert decode.features(tiles, bbox=(1.0, 1.0, 2.0, 2.0)).count() == 1
    over = combine.composite(tiles.select(F.lit(2).alias("z"), (F.col("x") * 3).alias("x"), (F.col("y") * 3).alias("y"), F.lit(None).cast("binary").alias("data")), tiles.select("z", "x", "y", F.lit(0).alias("src"), "data"))
    assert over.count() == 0 or over.count() <= 4


def test_modes_and_compression(spark):
    df = spark.createDataFrame([(0, 0, 0, bytearray(b"\x08\x01"))], "z int, x long, y long, data binary")
    assert decode.features(df, mode="permissive").first().corrupt
    with pytest.raises(Exception):
        decode.features(df).collect()
    raw = spark.createDataFrame([(bytearray(b"abcabc" * 9),), (None,)], "data binary")
    for gzip in (True, False):
        for level in (-1, 0, 9):
            both = raw.select("data", codec.decompress(codec.compress(F.col("data"), gzip, level)).alias("b")).collect()
            assert all(r.data == r.b for r in both)
    with pytest.raises(ValueError):
        codec.compress(F.col("data"), level=10)


def test_tile_files(spark, tmp_path):
    from tessera.sources import mvt

    mvt.register(spark)
    tiles = QUERIES["upgrade_v1"] and __import__("tessera.plans.queries", fromlist=["x"]).customer_tiles(spark, SF).select("z", "x", "y", "data")
    tiles.write.format("mvt").mode("append").save(str(tmp_path))
    back = spark.read.format("mvt").load(str(tmp_path))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, tiles.collect()))
    assert not [n for n in os.listdir(tmp_path) if not n.isdigit()]  # nothing staged is left
    some = tiles.where("x = 2")
    some.withColumn("data", F.lit(b"other")).write.format("mvt").mode("append").save(str(tmp_path))
    assert back.count() == tiles.count() and {bytes(r.data) for r in back.where("x = 2").collect()} == {b"other"}
    some.write.format("mvt").mode("overwrite").save("file://" + str(tmp_path))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, some.collect()))


def test_tile_files_conditions_choose_files(spark, tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, IsNull

    from tessera.sources import mvt

    mvt.register(spark)
    keys = [(z, x, y, bytearray(b"t")) for z in (0, 1, 2) for x in range(2**z) for y in range(2**z)]
    spark.createDataFrame(keys, "z int, x long, y long, data binary").write.format("mvt").mode("append").save(str(tmp_path))
    back = spark.read.format("mvt").load(str(tmp_path))
    for where in ("z = 2 and x > 1 and y <= 2", "x in (1, 3) and z >= 1", "z = 2 and y % 2 = 0", "z is not null and x = 9", "z <=> 1", "z = x"):
        want = spark.createDataFrame(keys, "z int, x long, y long, data binary").where(where)
        assert sorted(map(tuple, back.where(where).collect())) == sorted(map(tuple, want.collect()))
    reader = mvt._Reader(str(tmp_path), None)
    left = list(reader.pushFilters([EqualTo(("z",), 2), GreaterThan(("x",), 1), EqualTo(("data",), b"t"), IsNull(("z",))]))
    assert [type(f).__name__ for f in left] == ["EqualTo", "IsNull"]
    assert [p.value for p in reader.partitions()] == [(2, 2), (2, 3)]
    boxed = spark.read.format("mvt").option("bbox", "1,1,2,2").load(str(tmp_path))
    assert sorted((r.z, r.x, r.y) for r in boxed.collect()) == [(0, 0, 0), (1, 1, 0), (2, 2, 1)]
    edge = spark.read.format("mvt").option("bbox", "0,0,0,0").load(str(tmp_path)).where("z = 1")
    assert edge.count() == 4


def test_tile_files_of_a_failed_write_do_not_show(spark, tmp_path):
    from tessera.sources import mvt

    mvt.register(spark)
    keys = spark.createDataFrame([(0, 0, 0, bytearray(b"t"))], "z int, x long, y long, data binary")
    keys.write.format("mvt").mode("append").save(str(tmp_path))
    bad = spark.createDataFrame([(1, 0, 0, bytearray(b"u")), (1, None, 0, bytearray(b"u"))], "z int, x long, y long, data binary").coalesce(1)
    with pytest.raises(Exception, match="without key"):
        bad.write.format("mvt").mode("overwrite").save(str(tmp_path))
    assert [tuple(r) for r in spark.read.format("mvt").load(str(tmp_path)).collect()] == [(0, 0, 0, bytearray(b"t"))]
    assert os.listdir(tmp_path) == ["0"]


def test_max_extent_cuts_polygons(spark):
    h = M.HALF
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((-h, -h), (h, -h), (h, h), (-h, h), (-h, -h))])
    src = spark.range(1).select(geometry("polygon", F.array(F.array(ring))).alias("geom"), F.lit(7).alias("fid"))
    tiles = TileEncoder([LayerSpec("a", src)], EncodeOptions(max_extent=(-h / 2, 0.0, h / 4, h / 2), buffer_size=64)).encode(1)
    found = {(r.x, r.y): [(p.x, p.y) for p in r.geom.parts[0][0]] for r in decode.features(tiles, map_units=False).where("gtype = 3").collect()}
    assert {k: (min(v), max(v)) for k, v in found.items() if k in ((0, 0), (1, 0))} == {(0, 0): ((2048, 2048), (4160, 4096)), (1, 0): ((-64, 2048), (1024, 4096))}


def test_bounds_of_features_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "places")
    spark.range(-170, 171, 10).select("id", F.col("id").cast("double").alias("lon"), (F.col("id") / 2.0).alias("lat")).write.parquet(path)
    places = spark.read.parquet(path)
    source = places.select(point(F.col("lon"), F.col("lat")).alias("geom"), F.col("id").alias("fid"), "lon", "lat")
    box = (-M.HALF / 4, -M.HALF / 4, M.HALF / 4, M.HALF / 2)  # 45 degrees each way, 66.5 to the north
    options = EncodeOptions(max_extent=box)
    bounded = TileEncoder([LayerSpec("p", source, srs=4326, bounds=("lon", "lat", "lon", "lat"))], options).encode(2)
    plain = TileEncoder([LayerSpec("p", source, srs=4326)], options).encode(2)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")  # a scan's text is cut short, once
    plan = bounded._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, bounded.collect())) == sorted(map(tuple, plain.collect()))
    assert {r.fid for r in decode.features(bounded).collect()} == set(range(-40, 41, 10))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert all(f"{t}({c}," in plan for t in ("LessThanOrEqual", "GreaterThanOrEqual") for c in ("lon", "lat"))


def test_update_of_tiles_without_data(spark):
    src = spark.range(1).select(point(F.lit(5.0), F.lit(5.0)).alias("geom"), F.lit(1).alias("fid"))
    tiles = spark.createDataFrame([(1, 1, 0, None), (1, 0, 1, None), (2, 0, 0, None)], "z int, x long, y long, data binary")
    found = combine.update(tiles, 1, TileEncoder([LayerSpec("a", src)]))
    assert [(r.z, r.x, r.y) for r in found.collect()] == [(1, 1, 0)]


def test_features_at_point_returns_every_neighbour(spark, tmp_path):
    """Places repeat after 16,383 customers."""
    base = spark.read.parquet(f"{SF}/customer.parquet").where("c_custkey in (5, 6)")
    twin = base.where("c_custkey = 5").withColumn("c_custkey", F.col("c_custkey") + 16383)
    base.unionByName(twin.select(*[F.col(f.name).cast(f.dataType) for f in base.schema])).write.parquet(str(tmp_path / "customer.parquet"))
    assert sorted(r.c_custkey for r in QUERIES["features_at_point"](spark, str(tmp_path)).collect()) == [5, 16388]


def _filtered_png(image, kind):
    """A PNG whose rows all have one filter."""
    import struct
    import zlib

    plain = R.to_png(image)
    rows = image.reshape(image.shape[0], -1).astype(int)
    step = image.shape[2] if image.ndim == 3 else 1
    left = np.pad(rows, ((0, 0), (step, 0)))[:, : rows.shape[1]]
    up = np.pad(rows, ((1, 0), (0, 0)))[:-1]
    corner = np.pad(rows, ((1, 0), (step, 0)))[:-1, : rows.shape[1]]
    near = np.stack([left, up, corner])
    paeth = np.take_along_axis(near, np.abs(left + up - corner - near).argmin(0)[None], 0)[0]
    guess = [0 * rows, left, up, (left + up) // 2, paeth][kind]
    raw = np.hstack([np.full((len(rows), 1), kind), (rows - guess) % 256]).astype(np.uint8).tobytes()
    body = zlib.compress(raw)
    return plain[:33] + struct.pack(">I", len(body)) + b"IDAT" + body + b"\0\0\0\0" + plain[-12:]


@pytest.mark.parametrize("kind", range(5))
def test_images_come_back(kind):
    rng = np.random.default_rng(kind)
    for shape in ((5, 7), (1, 1), (6, 4, 3), (4, 6, 4)):
        image = rng.integers(0, 256, shape).astype(np.uint8)
        assert (R.from_bytes(_filtered_png(image, kind)) == image).all()
    for name in R.TYPES.values():
        image = (rng.random((3, 4)) * 100).astype(name)
        assert (R.from_bytes(R.to_bytes(image, "npy")) == image).all()
    deep = rng.integers(0, 65536, (3, 5)).astype(np.uint16)
    assert (R.from_bytes(R.to_png(deep)) == deep).all()
    with pytest.raises(ValueError):
        R.to_png(deep.astype(np.int32))


def test_sampling_and_painting():
    image = np.array([[0, 100], [200, 60]], np.uint8)
    at = np.array([0.25, 0.75, 1.25, 1.75])
    assert (R.sample(image, at, at) == image.repeat(2, 0).repeat(2, 1)).all()
    smooth = R.sample(image, at, at, "bilinear")
    assert smooth[0].tolist() == [0, 25, 75, 100] and smooth[1, 1] == round(0.75 * 25 + 0.25 * 165)
    clear = np.array([[[255, 0, 0, 255], [0, 255, 0, 0]]], np.uint8)
    assert R.sample(clear, np.array([0.5]), np.array([1.0]), "bilinear")[0, 0].tolist() == [255, 0, 0, 128]  # what is clear lends no colour
    h = M.HALF
    canvas = R.paint(image, (-h / 2, -h, h / 2, h / 2), 3857, 1, 1, 0, 8, "near")  # right half of the image, upper part
    assert (canvas[4:, :4] == 100).all() and canvas[:4].sum() == 0 and canvas[:, 4:].sum() == 0
    assert R.paint(image, (-h / 2, 0, -h / 4, h), 3857, 1, 1, 0, 8, "near") is None
    world = R.paint(np.arange(180, dtype=np.uint8).reshape(180, 1), (-180.0, -90.0, 180.0, 90.0), 4326, 0, 0, 0, 64, "near")
    assert world[0, 0] == math.floor(90 - math.degrees(2 * math.atan(math.exp((h - h / 64) / M.RADIUS)) - math.pi / 2)) and world[31, 5] == 87 and world[32, 5] == 92  # half a pixel of 360 / 64 degrees off the equator


def test_rasters_to_tiles_and_back(spark):
    h = M.HALF
    pixels = np.arange(64, dtype="<i2").reshape(8, 8) - 9
    rows = [(2, -h, -h, h, h, 8, 8, "gray16s", bytearray((pixels * 0 + 5).tobytes()), "b"), (1, -h, 0.0, 0.0, h, 8, 8, "gray16s", bytearray(pixels.tobytes()), "a")]
    rows += [rows[1], (0, None, 0.0, 0.0, h, 8, 8, "gray16s", bytearray(b""), "c"), (0, -h, 0.0, 0.0, h, 0, 8, "gray16s", bytearray(b""), "d")]
    schema = "fid long, minx double, miny double, maxx double, maxy double, width int, height int, type string, pixels binary, name string"
    source = spark.createDataFrame(rows, schema)
    tiles = R.encode_rasters(source, "r", 1, tile_size=16, form="npy")
    found = {(r.x, r.y): r for r in decode.features(tiles).collect()}
    assert {k: (r.fid, r.extent, r.attrs["name"].s) for k, r in found.items()} == {(0, 0): (1, 16, "a"), (1, 0): (2, 16, "b"), (0, 1): (2, 16, "b"), (1, 1): (2, 16, "b")}
    assert (R.from_bytes(found[0, 0].raster) == pixels.repeat(2, 0).repeat(2, 1)).all()
    part = R.read_rasters(decode.features(tiles), (-h * 0.74, h * 0.3, -h * 0.51, h * 0.45)).collect()
    assert len(part) == 1 and tuple(part[0].window)[:4] == (4, 8, 4, 4)
    assert (R.from_bytes(part[0].raster) == pixels.repeat(2, 0).repeat(2, 1)[8:12, 4:8]).all()
    assert tuple(part[0].window.box) == pytest.approx((-h * 0.75, h * 0.25, -h * 0.5, h * 0.5))
    assert R.encode_rasters(source.limit(0), "r", 1).count() == 0
    with pytest.raises(Exception, match="size"):
        R.encode_rasters(source.withColumn("pixels", F.lit(b"x")), "r", 1).collect()
    with pytest.raises(ValueError):
        R.encode_rasters(source, "r", 1, method="cubic")


def _random_lines(seed, n):
    """Batches for _to_commands: lines over tiles of zoom 2, on cells, between them and far out."""
    import pyarrow as pa

    rnd, side = random.Random(seed), 2 * M.HALF / 4
    cell = side / 4096

    def line():
        k = rnd.choice([0, 1, 2, 3, 5, 9, 40])
        if rnd.random() < 0.5:
            return [{"x": rnd.randrange(-9, 9) * side / 4, "y": rnd.randrange(-9, 9) * side / 4} for _ in range(k)]
        x, y = rnd.uniform(-M.HALF, M.HALF), rnd.uniform(-M.HALF, M.HALF)
        far = rnd.choice([1, 1, 1, 1e12])
        return [{"x": x + rnd.randrange(-40, 40) * cell / 2 * far, "y": y + rnd.randrange(-40, 40) * cell / 2} for _ in range(k)]

    rows = [{"kind": rnd.choice(["linestring", "multilinestring"]), "parts": [[line() for _ in range(rnd.randrange(1, 4))]]} for _ in range(n)]
    geom = pa.struct([("kind", pa.string()), ("parts", pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))))])
    longs = lambda v: pa.array(v, pa.int64())
    return pa.RecordBatch.from_arrays([longs([rnd.randrange(4) for _ in range(n)]), longs([rnd.randrange(4) for _ in range(n)]), longs(range(n)), longs(range(n)), pa.array([[]] * n, pa.map_(pa.string(), pa.int64())), pa.array(rows, geom)], names=["x", "y", "ord", "fid", "attrs", "geom"])


@pytest.mark.parametrize("options", [{}, {"simplify_distance": 4}, {"simplify_distance": 0.5, "offset_x": 7}, {"simplify_distance": 60, "max_extent": (-M.HALF / 3, -M.HALF / 2, M.HALF / 5, M.HALF / 7)}])
def test_lines_as_arrays_are_lines_one_by_one(monkeypatch, options):
    from tessera.operators import encode as E
    from tessera.operators import lines as L

    batch, o = _random_lines(3, 600), E.EncodeOptions(**options)
    for cells in (0.0, 64.0):
        found = next(E._to_commands(o, 4096, cells, 2)(iter([batch]))).to_pylist()
        with monkeypatch.context() as m:
            m.setattr(L, "EXACT", -1.0)  # nothing is left to arrays
            assert next(E._to_commands(o, 4096, cells, 2)(iter([batch]))).to_pylist() == found
        assert len(found) > 50


def test_lines_take_no_call_for_each_feature(monkeypatch):
    """From rows to a tile and its summary: calls grow with the blocks, not with the features."""
    import pyarrow as pa

    from tessera.operators import encode as E
    from tessera.operators import tile as T
    from tessera.operators import wire as W

    calls = []
    for where, name in ((G, "clip_line"), (G, "douglas_peucker"), (T.LayerWriter, "add_coded"), (W, "fields"), (W, "varint")):
        own = getattr(where, name)
        monkeypatch.setattr(where, name, lambda *a, own=own: calls.append(1) or own(*a))
    rows = [{"kind": "linestring", "parts": [[[{"x": i * 2000.0, "y": 0.0}, {"x": i * 2000.0 + 9e4, "y": 5e4}, {"x": i * 2000.0, "y": 9e4}]]]} for i in range(900)]
    batch = _random_lines(1, 900)
    zero = pa.array([0] * 900, pa.int64())
    batch = pa.RecordBatch.from_arrays([zero, zero, *batch.columns[2:5], pa.array(rows, batch.schema.field("geom").type)], names=batch.schema.names)
    coded = pa.Table.from_batches(E._to_commands(E.EncodeOptions(simplify_distance=4), 4096, 0.0, 0)(iter([batch])))
    tile = E._assemble({"a": 4096}, ["a"])((pa.scalar(0), pa.scalar(0)), coded.append_column("layer", pa.array(["a"] * len(coded)))).to_pylist()[0]
    (layer,) = T.layers(tile["data"])
    s = T.summary(layer)
    assert (tile["n_features"], s["n_features"], s["n_move"], s["n_line"]) == (900, 900, 900, 1800)
    assert len(calls) < 100
    monkeypatch.undo()
    w = T.LayerWriter("a")
    for r in coded.to_pylist():
        w.add_coded(r["code"], r["fid"], {})
    assert tile["data"] == w.bytes()
    found = dict.fromkeys(("n_ints", "n_cmds", "n_move", "n_line", "n_close", "n_degenerate", "n_empty"), 0)
    for f in T.Layer(layer).features:
        T._feature_counts(f, found)
    assert {k: s[k] for k in found} == found


def test_few_edges_need_no_arrays(monkeypatch):
    """Two boxes, a notch, random rings: what arrays find is found edge by edge."""
    rnd = random.Random(4)
    cases = [([[(0, 0), (9, 0), (9, 9), (0, 9), (0, 0)], [(3, 4), (12, 4), (12, 13), (3, 13), (3, 4)]], f) for f in overlay.INSIDE]
    for _ in range(60):
        side = rnd.choice([4, 9, 4000])
        rings = [[(rnd.randrange(side), rnd.randrange(side)) for _ in range(rnd.randrange(3, 9))] for _ in range(rnd.randrange(1, 4))]
        cases.append(([[*r, r[0]] for r in rings], rnd.choice(list(overlay.INSIDE))))
    with monkeypatch.context() as m:
        m.setattr(overlay, "_noded", None)
        m.setattr(overlay, "_sides", None)
        found = [overlay.union(*c) for c in cases]
    monkeypatch.setattr(overlay, "FEW", 0)
    assert [overlay.union(*c) for c in cases] == found


def test_rings_within_the_box_stay_and_others_are_cut():
    ring = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
    assert G.clip_ring(ring, (0, 0, 10, 10)) == ring
    assert G.area2(G.clip_ring(ring, (0, 0, 10, 9))[:-1]) == 180
