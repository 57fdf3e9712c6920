"""Registered queries of the tile engine, each with its SQL.

Geometry comes from key columns: a customer or supplier has a place on a grid of 2**20
cells over the world, an order is a line through its items, a part is a box."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import cmds as C
from tessera.functions import codec
from tessera.functions import tilemath as M
from tessera.operators import combine, decode
from tessera.operators.encode import EncodeOptions, LayerSpec, TileEncoder, geometry, point

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
GRID = 1 << 20
H = "20037508.342789244"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def place(key: str) -> tuple[Column, Column]:
    k = F.col(key).cast("long")
    return (k * 48271 + 11) % 16383 * 64 + 32, (k * 69621 + 7) % 16383 * 64 + 32


def customers(spark: SparkSession, sf: str) -> DataFrame:
    """customer with gx, gy and map units mx, my."""
    gx, gy = place("c_custkey")
    c = read(spark, sf, "customer").withColumns({"gx": gx, "gy": gy})
    cell = 2 * M.HALF / GRID
    return c.withColumns({"mx": F.col("gx") * cell - M.HALF, "my": F.lit(M.HALF) - F.col("gy") * cell})


_PLACED = f"""WITH c AS (SELECT *, (CAST(c_custkey AS BIGINT) * 48271 + 11) % 16383 * 64 + 32 AS gx, (CAST(c_custkey AS BIGINT) * 69621 + 7) % 16383 * 64 + 32 AS gy FROM customer),
m AS (SELECT *, gx * (2 * {H}::DOUBLE / {GRID}) - {H}::DOUBLE AS mx, {H}::DOUBLE - gy * (2 * {H}::DOUBLE / {GRID}) AS my FROM c)
"""


def order_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A line of points (x, y) through the items of each order."""
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items"))
    xy = F.transform("items", lambda i: F.struct((i["l_partkey"].cast("long") % 64).alias("x"), (i["l_suppkey"].cast("long") % 8).alias("y")))
    return lines.select("l_orderkey", xy.alias("points"))


_LINES = """WITH p AS (SELECT l_orderkey, row_number() OVER w AS i, CAST(l_partkey AS BIGINT) % 64 AS x, CAST(l_suppkey AS BIGINT) % 8 AS y
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
q AS (SELECT *, lag(x) OVER (PARTITION BY l_orderkey ORDER BY i) AS px, lag(y) OVER (PARTITION BY l_orderkey ORDER BY i) AS py FROM p),
r AS (SELECT l_orderkey, x, y, row_number() OVER (PARTITION BY l_orderkey ORDER BY i) AS i FROM q WHERE px IS NULL OR px <> x OR py <> y),
d AS (SELECT *, x - coalesce(lag(x) OVER (PARTITION BY l_orderkey ORDER BY i), 0) AS dx, y - coalesce(lag(y) OVER (PARTITION BY l_orderkey ORDER BY i), 0) AS dy FROM r),
z AS (SELECT *, CASE WHEN dx < 0 THEN -2 * dx - 1 ELSE 2 * dx END AS zx, CASE WHEN dy < 0 THEN -2 * dy - 1 ELSE 2 * dy END AS zy FROM d)
"""


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    """A box of each part: x0, y0, x1, y1 and its closed ring."""
    k = F.col("p_partkey").cast("long")
    p = read(spark, sf, "part").select("p_partkey", (k * 37 % 5000 - 400).alias("minx"), (k * 91 % 5000 - 400).alias("miny"), (k % 300).alias("w"), (k % 170).alias("h"))
    p = p.select("p_partkey", F.struct("minx", "miny", (F.col("minx") + F.col("w")).alias("maxx"), (F.col("miny") + F.col("h")).alias("maxy")).alias("box"))
    return p.withColumn("ring", C.box_ring(F.col("box")))


_BOXES = """WITH b AS (SELECT p_partkey, CAST(p_partkey AS BIGINT) * 37 % 5000 - 400 AS x0, CAST(p_partkey AS BIGINT) * 91 % 5000 - 400 AS y0, CAST(p_partkey AS BIGINT) % 300 AS w, CAST(p_partkey AS BIGINT) % 170 AS h FROM part)
"""


def joined(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda v: v.cast("string")), ",")


# -- tile arithmetic ------------------------------------------------------------------


@query("SELECT n_nationkey, round(n_nationkey * s - h, 6) AS minx, round(h - (y + 1) * s, 6) AS miny, round((n_nationkey + 1) * s - h, 6) AS maxx, round(h - y * s, 6) AS maxy "
       f"FROM (SELECT n_nationkey, n_regionkey AS y, 2 * {H}::DOUBLE / 32 AS s, {H}::DOUBLE AS h FROM nation)")
def tile_bbox(spark, sf):
    n = read(spark, sf, "nation").withColumn("b", M.tile_bbox(5, F.col("n_nationkey"), F.col("n_regionkey")))
    return n.select("n_nationkey", *[F.round(F.col("b")[c], 6).alias(c) for c in ("minx", "miny", "maxx", "maxy")])


@query(f"""SELECT n_nationkey, round(cx - nw / 2, 6) AS minx, round(cx + nw / 2, 6) AS maxx, round(s / 4096, 6) AS scale FROM (
SELECT n_nationkey, s, n_nationkey * s - h + s / 2 AS cx, greatest(s + s / 4096 * 2 * (n_nationkey * 256 - 3000), 0) AS nw FROM (SELECT n_nationkey, 2 * {H}::DOUBLE / 32 AS s, {H}::DOUBLE AS h FROM nation))""")
def tile_buffered_extent(spark, sf):
    n = read(spark, sf, "nation").withColumn("b", M.tile_bbox(5, F.col("n_nationkey"), F.col("n_regionkey")))
    n = n.withColumn("g", M.buffered(F.col("b"), 4096, F.col("n_nationkey") * 256 - 3000))
    return n.select("n_nationkey", F.round("g.minx", 6).alias("minx"), F.round("g.maxx", 6).alias("maxx"), F.round(M.units_per_cell(F.col("b.maxx") - F.col("b.minx"), 4096), 6).alias("scale"))


@query(_PLACED + "SELECT c_custkey, gx // 65536 AS tx, gy // 65536 AS ty FROM c")
def tile_assign_points(spark, sf):
    c = customers(spark, sf)
    return c.select("c_custkey", F.floor(F.col("gx") / 65536).alias("tx"), F.floor(F.col("gy") / 65536).alias("ty"))


@query(_PLACED + """, t AS (SELECT CAST(unnest(CASE WHEN gx % 65536 = 0 AND gx > 0 THEN [gx // 65536 - 1, gx // 65536] ELSE [gx // 65536] END) AS BIGINT) AS x, gy FROM c)
, u AS (SELECT x, CAST(unnest(CASE WHEN gy % 65536 = 0 AND gy > 0 THEN [gy // 65536 - 1, gy // 65536] ELSE [gy // 65536] END) AS BIGINT) AS y FROM t)
SELECT x, y, count(*) AS n FROM u GROUP BY 1, 2""")
def tile_feature_counts(spark, sf):
    """A point on an edge belongs to every tile that touches it."""
    c = customers(spark, sf)
    t = c.select(F.explode(M.covering_tiles(F.col("mx"), F.col("my"), F.col("mx"), F.col("my"), 4)).alias("t"))
    return t.groupBy(F.col("t.x").alias("x"), F.col("t.y").alias("y")).agg(F.count("*").alias("n"))


@query(_PLACED + "SELECT c_custkey, CAST(round((gx % 65536) / 16.0::DOUBLE) AS BIGINT) AS px, CAST(round((gy % 65536) / 16.0::DOUBLE) AS BIGINT) AS py FROM c")
def point_to_tile_coords(spark, sf):
    c = customers(spark, sf)
    box = M.tile_bbox(4, F.floor(F.col("gx") / 65536), F.floor(F.col("gy") / 65536))
    return c.withColumn("p", M.to_grid(F.col("mx"), F.col("my"), box, 4096)).select("c_custkey", F.col("p.x").alias("px"), F.col("p.y").alias("py"))


@query(_PLACED + f"SELECT c_custkey FROM m WHERE mx BETWEEN -{H}::DOUBLE / 2 AND {H}::DOUBLE / 3 AND my BETWEEN -{H}::DOUBLE / 3 AND {H}::DOUBLE / 2")
def point_bbox_filter(spark, sf):
    box = F.struct(F.lit(-M.HALF / 2).alias("minx"), F.lit(-M.HALF / 3).alias("miny"), F.lit(M.HALF / 3).alias("maxx"), F.lit(M.HALF / 2).alias("maxy"))
    return customers(spark, sf).where(M.inside(F.col("mx"), F.col("my"), box)).select("c_custkey")


@query("SELECT s_suppkey, round(lon * (20037508.342789244::DOUBLE / 180), 3) AS x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137, 3) + 0.0 AS y FROM (SELECT s_suppkey, CAST(s_suppkey * 7 % 360 - 180 AS DOUBLE) AS lon, CAST(s_suppkey * 13 % 170 - 85 AS DOUBLE) AS lat FROM supplier)")
def lonlat_to_mercator(spark, sf):
    s = read(spark, sf, "supplier").select("s_suppkey", (F.col("s_suppkey") * 7 % 360 - 180).cast("double").alias("lon"), (F.col("s_suppkey") * 13 % 170 - 85).cast("double").alias("lat"))
    return s.withColumn("m", M.lonlat_to_mercator(F.col("lon"), F.col("lat"))).select("s_suppkey", F.round("m.x", 3).alias("x"), (F.round("m.y", 3) + F.lit(0.0)).alias("y"))


@query(f"SELECT n_nationkey, d BETWEEN 100000 AND 20000000 AS visible FROM (SELECT n_nationkey, 2 * {H}::DOUBLE / power(2, n_nationkey) / 256 / 0.00028 AS d FROM nation)")
def scale_visible_layers(spark, sf):
    n = read(spark, sf, "nation")
    d = M.scale_denominator(F.lit(2 * M.HALF) / M.tiles_across(F.col("n_nationkey")))
    return n.select("n_nationkey", M.visible(d, 100000.0, 20000000.0).alias("visible"))


@query(f"""SELECT n_nationkey, round(greatest(a, -30), 6) AS minx, round(least(c, 40), 6) AS maxx, round(greatest(b, -10), 6) AS miny, round(least(d, 80), 6) AS maxy, round(4096 / (c - a), 6) AS res_x, round(4096 / (d - b), 6) AS res_y FROM (
SELECT n_nationkey, lon AS a, lon + 180.0::DOUBLE / 16 AS c, degrees(2 * atan(exp((h - (y + 1) * s) / 6378137))) - 90 AS b, degrees(2 * atan(exp((h - y * s) / 6378137))) - 90 AS d FROM (
SELECT n_nationkey, n_nationkey * (180.0::DOUBLE / 16) - 180 AS lon, 10 + n_regionkey AS y, 2 * {H}::DOUBLE / 32 AS s, {H}::DOUBLE AS h FROM nation)) WHERE c >= -30 AND a <= 40 AND d >= -10 AND b <= 80""")
def layer_query_extent(spark, sf):
    """What tiles ask of a layer in degrees, and at which resolution."""
    n = read(spark, sf, "nation").withColumn("b", M.tile_bbox(5, F.col("n_nationkey"), F.lit(10) + F.col("n_regionkey")))
    layer = F.struct(*[F.lit(float(v)).alias(k) for k, v in (("minx", -30), ("miny", -10), ("maxx", 40), ("maxy", 80))])
    n = n.withColumns({"q": M.query_extent(layer, F.col("b"), 4326), "r": M.query_resolution(F.col("b"), 4096, 4326)}).where("q is not null")
    return n.select("n_nationkey", *[F.round(F.col("q")[c], 6).alias(c) for c in ("minx", "maxx", "miny", "maxy")], F.round("r.x", 6).alias("res_x"), F.round("r.y", 6).alias("res_y"))


# -- geometry -------------------------------------------------------------------------


@query(_LINES + "SELECT l_orderkey, count(*) AS n, string_agg(x || ' ' || y, ',' ORDER BY i) AS points FROM r GROUP BY 1")
def line_dedupe(spark, sf):
    p = order_lines(spark, sf).withColumn("d", C.dedupe(F.col("points")))
    text = F.array_join(F.transform("d", lambda q: F.concat_ws(" ", q["x"].cast("string"), q["y"].cast("string"))), ",")
    return p.select("l_orderkey", F.size("d").cast("long").alias("n"), text.alias("points"))


@query(_LINES + "SELECT l_orderkey, string_agg(x || ' ' || y, ',' ORDER BY i) AS points FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY i) AS k, lag(x) OVER (PARTITION BY l_orderkey ORDER BY i) AS ax, lag(y) OVER (PARTITION BY l_orderkey ORDER BY i) AS ay FROM p WHERE x BETWEEN 10 AND 50 AND y BETWEEN 2 AND 5) WHERE ax IS NULL OR ax <> x OR ay <> y GROUP BY 1")
def multipoint_filter_dedupe(spark, sf):
    some = F.filter("points", lambda q: q["x"].between(10, 50) & q["y"].between(2, 5))
    p = order_lines(spark, sf).withColumn("some", some).withColumn("d", C.dedupe(F.col("some"))).where("size(d) > 0")
    return p.select("l_orderkey", F.array_join(F.transform("d", lambda q: F.concat_ws(" ", q["x"].cast("string"), q["y"].cast("string"))), ",").alias("points"))


@query(_LINES + "SELECT l_orderkey, min(x) AS minx, max(y) AS maxy FROM p GROUP BY 1 HAVING min(x) <= 20 AND max(x) >= 12 AND min(y) <= 3 AND max(y) >= 2")
def line_envelope_filter(spark, sf):
    p = order_lines(spark, sf).withColumn("e", C.envelope(F.col("points")))
    box = F.struct(F.lit(12).alias("minx"), F.lit(2).alias("miny"), F.lit(20).alias("maxx"), F.lit(3).alias("maxy"))
    return p.where(M.intersects(F.col("e"), box)).select("l_orderkey", F.col("e.minx").alias("minx"), F.col("e.maxy").alias("maxy"))


@query(_LINES + "SELECT l_orderkey FROM r GROUP BY 1 HAVING count(*) < 2")
def line_degenerate_filter(spark, sf):
    return order_lines(spark, sf).where(C.encode_line(F.col("points")).isNull()).select("l_orderkey")


@query(_LINES + "SELECT l_orderkey, '9,' || any_value(CASE WHEN i = 1 THEN zx || ',' || zy END) || ',' || ((count(*) - 1) * 8 + 2) || ',' || string_agg(zx || ',' || zy, ',' ORDER BY i) FILTER (i > 1) AS cmds FROM z GROUP BY 1 HAVING count(*) >= 2")
def encode_line_cmds(spark, sf):
    p = order_lines(spark, sf).withColumn("c", C.encode_line(F.col("points"))).where("c is not null")
    return p.select("l_orderkey", joined(F.col("c")).alias("cmds"))


@query(_LINES + """, e AS (SELECT *, x - coalesce(px, 0) AS ex, y - coalesce(py, 0) AS ey FROM q)
SELECT l_orderkey, (count(*) * 8 + 1) || ',' || string_agg((CASE WHEN ex < 0 THEN -2 * ex - 1 ELSE 2 * ex END) || ',' || (CASE WHEN ey < 0 THEN -2 * ey - 1 ELSE 2 * ey END), ',' ORDER BY i) AS cmds FROM e GROUP BY 1""")
def encode_multipoint_cmds(spark, sf):
    return order_lines(spark, sf).select("l_orderkey", joined(C.encode_points(F.col("points"))).alias("cmds"))


@query(_PLACED + "SELECT c_custkey, '9,' || 2 * gx || ',' || 2 * gy AS cmds FROM c")
def encode_point_cmds(spark, sf):
    c = customers(spark, sf)
    return c.select("c_custkey", joined(C.encode_points(F.array(F.struct(F.col("gx").alias("x"), F.col("gy").alias("y"))))).alias("cmds"))


@query(_PLACED + "SELECT c_custkey, gx AS x, gy AS y, round(100 + gx / 0.5::DOUBLE, 6) AS rescaled FROM c")
def decode_point_cmds(spark, sf):
    c = customers(spark, sf).withColumn("p", F.element_at(C.decode_points(C.encode_points(F.array(F.struct(F.col("gx").alias("x"), F.col("gy").alias("y"))))), 1))
    return c.select("c_custkey", F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.round(F.lit(100) + F.col("p.x") / 0.5, 6).alias("rescaled"))


@query("SELECT p_partkey, v, CASE WHEN v < 0 THEN -2 * v - 1 ELSE 2 * v END AS coded, v AS back FROM (SELECT p_partkey, CAST(p_partkey AS BIGINT) * 7919 % 10000 - 5000 AS v FROM part)")
def zigzag_codec(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", (F.col("p_partkey").cast("long") * 7919 % 10000 - 5000).alias("v"))
    return p.withColumn("coded", C.zigzag(F.col("v"))).withColumn("back", C.unzigzag(F.col("coded")))


@query("SELECT p_partkey, CAST(p_partkey AS BIGINT) * 8 + 1 AS move_to, CAST(p_partkey AS BIGINT) * 8 + 2 AS line_to FROM part")
def command_words(spark, sf):
    return read(spark, sf, "part").select("p_partkey", C.command(1, F.col("p_partkey")).alias("move_to"), C.command(2, F.col("p_partkey")).alias("line_to"))


@query(_BOXES + "SELECT p_partkey, 2 * w * h AS area2, w * h >= 400 AS kept FROM b")
def ring_signed_area(spark, sf):
    b = boxes(spark, sf).withColumn("area2", C.ring_area2(F.col("ring")))
    return b.select("p_partkey", "area2", (F.abs("area2") >= 800).alias("kept"))


@query(_BOXES + """, e AS (SELECT p_partkey, [x0, y0, w, h] AS v FROM b WHERE w > 0 AND h > 0)
SELECT p_partkey, '9,' || (CASE WHEN v[1] < 0 THEN -2 * v[1] - 1 ELSE 2 * v[1] END) || ',' || (CASE WHEN v[2] < 0 THEN -2 * v[2] - 1 ELSE 2 * v[2] END) || ',26,' || 2 * v[3] || ',0,0,' || 2 * v[4] || ',' || (2 * v[3] - 1) || ',0,15' AS cmds FROM e""")
def encode_ring_cmds(spark, sf):
    b = boxes(spark, sf).where("box.maxx > box.minx and box.maxy > box.miny")
    return b.select("p_partkey", joined(C.encode_ring(F.col("ring"))).alias("cmds"))


@query(_BOXES + """, c AS (SELECT p_partkey, greatest(x0, 0) AS a, greatest(y0, 0) AS b, least(x0 + w, 4096) AS c, least(y0 + h, 4096) AS d FROM b WHERE w > 0 AND h > 0)
SELECT p_partkey, 2 * (c - a) * (d - b) AS area2 FROM c WHERE c > a AND d > b""")
def clip_polygon_box(spark, sf):
    """Boxes cut to the tile by the general clipper."""
    from tessera.operators import geometry as G

    @F.pandas_udf("long")
    def area(ring: pd.Series) -> pd.Series:
        return ring.map(lambda r: int(G.area2(c[:-1])) if len(c := G.clip_ring([(p["x"], p["y"]) for p in r], (0, 0, 4096, 4096))) else 0)

    b = boxes(spark, sf).where("box.maxx > box.minx and box.maxy > box.miny")
    return b.select("p_partkey", area("ring").alias("area2")).where("area2 <> 0")


_TWO = _BOXES + """, two AS (SELECT p_partkey, x0, y0, x0 + w AS x1, y0 + h AS y1, x0 + w // 3 AS u0, y0 + h // 2 AS v0, x0 + w // 3 + w AS u1, y0 + h // 2 + h AS v1, w, h FROM b WHERE w > 0 AND h > 0),
cut AS (SELECT p_partkey, w, h, greatest(least(x1, 4096) - greatest(x0, 0), 0) * greatest(least(y1, 4096) - greatest(y0, 0), 0) AS one,
greatest(least(u1, 4096) - greatest(u0, 0), 0) * greatest(least(v1, 4096) - greatest(v0, 0), 0) AS other,
greatest(least(x1, u1, 4096) - greatest(x0, u0, 0), 0) * greatest(least(y1, v1, 4096) - greatest(y0, v0, 0), 0) AS shared FROM two)
"""


@query(_TWO + "SELECT p_partkey, 2 * (one + other - shared) AS joined2, 2 * (one + other - 2 * shared) AS odd2, 2 * (one + other) AS apart2, CAST(2 AS BIGINT) AS n_arms, 24 * (w + 1) * (h + 1) AS arms2 FROM cut")
def clip_polygon_general(spark, sf):
    """Two boxes that overlap, cut to the tile: joined, joined under the even-odd rule, and
    each on its own; and a ring with a notch, cut through its two arms."""
    from tessera.operators import geometry as G

    def ring(x, y, w, h):
        return [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]

    @F.pandas_udf("joined2 long, odd2 long, apart2 long, n_arms long, arms2 long")
    def areas(x0: pd.Series, y0: pd.Series, w: pd.Series, h: pd.Series) -> pd.DataFrame:
        total = lambda g: sum(G.area2(r[:-1]) for p in g[1] for r in p)
        out = []
        for x, y, a, b in zip(x0, y0, w, h, strict=True):
            two = ("multipolygon", [[ring(x, y, a, b)], [ring(x + a // 3, y + b // 2, a, b)]])
            ways = [G.clip(two, (0, 0, 4096, 4096), union=u, fill=f) for u, f in ((True, "positive"), (True, "even_odd"), (False, "positive"))]
            a, b = 6 * (a + 1), 6 * (b + 1)
            notched = [(0, 0), (a, 0), (a, b // 3), (a // 3, b // 3), (a // 3, 2 * b // 3), (a, 2 * b // 3), (a, b), (0, b), (0, 0)]
            arms = G.clip(("polygon", [[notched]]), (a // 2, 0, a, b))
            out.append([*map(total, ways), len(arms[1]), total(arms)])
        return pd.DataFrame(out, columns=["joined2", "odd2", "apart2", "n_arms", "arms2"], dtype="int64")

    b = boxes(spark, sf).where("box.maxx > box.minx and box.maxy > box.miny")
    b = b.repartition(spark.sparkContext.defaultParallelism)  # short rows, a millisecond each: dealt by number, which stays as it is
    x, y, w, h = F.col("box.minx"), F.col("box.miny"), F.col("box.maxx") - F.col("box.minx"), F.col("box.maxy") - F.col("box.miny")
    return b.select("p_partkey", areas(x, y, w, h).alias("a")).select("p_partkey", "a.*")


@query(_BOXES + "SELECT p_partkey, greatest(x0, 0) AS a, least(x0 + w, 4096) AS b FROM b WHERE y0 BETWEEN 0 AND 4096 AND w > 0 AND least(x0 + w, 4096) > greatest(x0, 0)")
def clip_line_box(spark, sf):
    from tessera.operators import geometry as G

    @F.pandas_udf("array<long>")
    def cut(box: pd.DataFrame) -> pd.Series:
        return box.apply(lambda r: [int(p[0][p2][0]) for p2 in (0, -1)] if (p := G.clip_line([(r["minx"], r["miny"]), (r["maxx"], r["miny"])], (0, 0, 4096, 4096))) else [], axis=1)

    b = boxes(spark, sf).where("box.maxx > box.minx").withColumn("c", cut("box")).where("size(c) > 0")
    return b.select("p_partkey", F.col("c")[0].alias("a"), F.col("c")[1].alias("b"))


# -- attributes and tiles -------------------------------------------------------------


@query("SELECT c_custkey, CASE WHEN CAST(CAST(v AS FLOAT) AS DOUBLE) = v THEN 'float' ELSE 'double' END AS kind FROM (SELECT c_custkey, CAST(c_acctbal AS DOUBLE) AS v FROM customer)")
def value_wire_type(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", C.wire_type(F.col("c_acctbal").cast("double")).alias("kind"))


def customer_tiles(spark, sf, z: int = 3) -> DataFrame:
    """Customers with segment and nation as tiles."""
    c = customers(spark, sf)
    source = c.select(point(F.col("mx"), F.col("my")).alias("geom"), F.col("c_custkey").alias("fid"), "c_mktsegment", F.col("c_nationkey").cast("int").alias("c_nationkey"))
    return TileEncoder([LayerSpec("customers", source)], EncodeOptions()).encode(z)


_TILED = _PLACED + """, t AS (SELECT *, CAST(unnest(CASE WHEN gx % 131072 = 0 AND gx > 0 THEN [gx // 131072 - 1, gx // 131072] ELSE [gx // 131072] END) AS BIGINT) AS x FROM c),
u AS (SELECT *, CAST(unnest(CASE WHEN gy % 131072 = 0 AND gy > 0 THEN [gy // 131072 - 1, gy // 131072] ELSE [gy // 131072] END) AS BIGINT) AS y FROM t)
"""


@query(_TILED + "SELECT x, y, count(*) AS n_features, CAST(2 AS BIGINT) AS n_keys, count(DISTINCT c_mktsegment) + count(DISTINCT c_nationkey) AS n_values FROM u GROUP BY 1, 2")
def encode_tiles(spark, sf):
    return customer_tiles(spark, sf).select("x", "y", "n_features", "n_keys", "n_values")


@query(_TILED + "SELECT x, y, 'customers' AS layer, CAST(2 AS INTEGER) AS version, CAST(4096 AS BIGINT) AS extent, count(*) AS n_features, 3 * count(*) AS n_ints, count(*) AS n_move, CAST(0 AS BIGINT) AS n_close FROM u GROUP BY 1, 2")
def tileinfo_summary(spark, sf):
    return decode.tile_info(customer_tiles(spark, sf)).select("x", "y", "layer", "version", "extent", "n_features", "n_ints", "n_move", "n_close")


@query(_TILED + "SELECT x, y, c_custkey, CAST(round((gx - x * 131072) / 32.0::DOUBLE) AS BIGINT) AS px, CAST(round((gy - y * 131072) / 32.0::DOUBLE) AS BIGINT) AS py, c_mktsegment AS segment, CAST(c_nationkey AS BIGINT) AS nation FROM u")
def round_trip(spark, sf):
    found = decode.pivot(decode.features(customer_tiles(spark, sf), map_units=False), {"c_mktsegment": "string", "c_nationkey": "bigint"})
    p = F.col("geom.parts")[0][0][0]
    return found.select("x", "y", F.col("fid").alias("c_custkey"), p["x"].cast("long").alias("px"), p["y"].cast("long").alias("py"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))


@query(_TILED + "SELECT x, y, c_custkey, CAST(c_nationkey AS BIGINT) AS nation FROM u")
def attribute_projection(spark, sf):
    found = decode.features(customer_tiles(spark, sf), names=["c_nationkey"])
    return found.where("not map_contains_key(attrs, 'c_mktsegment')").select("x", "y", F.col("fid").alias("c_custkey"), F.col("attrs")["c_nationkey"]["i"].alias("nation"))


@query(_TILED + f""", d AS (SELECT c_custkey, (x * 131072 + 32 * round((gx - x * 131072) / 32.0::DOUBLE)) * (2 * {H}::DOUBLE / {GRID}) AS dx, (y * 131072 + 32 * round((gy - y * 131072) / 32.0::DOUBLE)) * (2 * {H}::DOUBLE / {GRID}) AS dy FROM u),
here AS (SELECT gx * (2 * {H}::DOUBLE / {GRID}) AS ax, gy * (2 * {H}::DOUBLE / {GRID}) AS ay FROM c WHERE c_custkey = 5)
SELECT DISTINCT c_custkey FROM d, here WHERE abs(dx - ax) <= 20000 AND abs(dy - ay) <= 20000""")
def features_at_point(spark, sf):
    """All features within 20 km, each way, of where customer 5 is; places are those of
    the tile's grid."""
    at = customers(spark, sf).where("c_custkey = 5").select("mx", "my").first()
    found = decode.features_at(customer_tiles(spark, sf), at.mx if at else 0.0, at.my if at else 0.0, 20_000.0) if at else decode.features(customer_tiles(spark, sf).limit(0))
    return found.select(F.col("fid").alias("c_custkey")).distinct()


@query(_TILED + "SELECT x, y, CAST(row_number() OVER (PARTITION BY x, y ORDER BY f) - 1 AS BIGINT) AS idx, c_mktsegment AS segment FROM (SELECT x, y, c_mktsegment, min(c_custkey) AS f FROM u GROUP BY 1, 2, 3)")
def value_dictionary(spark, sf):
    """First-seen numbers of segments, from the tiles' tags."""
    from tessera.operators import tile as T

    def rows(z, x, y, data):
        t = T.Layer(T.layers(data)[0])
        return [{"idx": i, "segment": v} for i, v in enumerate(v for tag, v in t.values if tag == 1)]

    return decode._expand(customer_tiles(spark, sf), "idx bigint, segment string", rows).drop("z")


@query(_TILED + "SELECT x, y, count(*) > 0 AS painted, count(*) FILTER (c_acctbal < -900) = 0 AS debtors_empty FROM u GROUP BY 1, 2")
def layer_painted_empty(spark, sf):
    c = customers(spark, sf)
    rows = c.select(point(F.col("mx"), F.col("my")).alias("geom"), F.col("c_custkey").alias("fid"), "c_acctbal")
    tiles = TileEncoder([LayerSpec("customers", rows.drop("c_acctbal")), LayerSpec("debtors", rows.where("c_acctbal < -900").drop("c_acctbal"))]).encode(3)
    return tiles.select("x", "y", F.array_contains("painted", "customers").alias("painted"), F.array_contains("empty", "debtors").alias("debtors_empty"))


@query(_TILED + "SELECT x, y, CAST(2 AS BIGINT) AS n_layers, count(*) AS n_features FROM u GROUP BY 1, 2")
def merge_first_wins(spark, sf):
    """Two sources hold a layer of the same name and one of another; the first wins."""
    c = customers(spark, sf)
    rows = c.select(point(F.col("mx"), F.col("my")).alias("geom"), F.col("c_custkey").alias("fid"), "c_mktsegment")
    one = TileEncoder([LayerSpec("a", rows)]).encode(3).withColumn("src", F.lit(0))
    two = TileEncoder([LayerSpec("a", rows.where("fid % 2 = 0")), LayerSpec("b", rows)]).encode(3).withColumn("src", F.lit(1))
    merged = combine.merge(one.unionByName(two))
    return decode.tile_info(merged).groupBy("x", "y").agg(F.count("*").alias("n_layers"), F.sum(F.when(F.col("layer") == "a", F.col("n_features"))).alias("n_features"))


@query(_TILED + "SELECT 2 * x AS x, 2 * y AS y, count(*) AS n FROM u WHERE gx BETWEEN x * 131072 AND x * 131072 + 65536 AND gy BETWEEN y * 131072 AND y * 131072 + 65536 GROUP BY 1, 2")
def overzoom(spark, sf):
    """Upper-left children of each tile, from their parents."""
    tiles = customer_tiles(spark, sf)
    targets = tiles.select(F.lit(4).alias("z"), (F.col("x") * 2).alias("x"), (F.col("y") * 2).alias("y"), F.lit(None).cast("binary").alias("data"))
    out = combine.composite(targets, tiles.select("z", "x", "y", F.lit(0).alias("src"), "data"))
    return decode.tile_info(out).select("x", "y", F.col("n_features").alias("n"))


@query(_TILED + "SELECT x, y, 'customers' AS name, '' AS codes, count(*) AS point FROM u GROUP BY 1, 2")
def validate_errors(spark, sf):
    return decode.errors(customer_tiles(spark, sf)).select("x", "y", "name", F.array_join("codes", ",").alias("codes"), "point")


def _with(extra: list[bytes]):
    """A tile's only layer with a field behind it, one of ``extra`` by the tile's key."""

    @F.pandas_udf("binary")
    def run(data: pd.Series, which: pd.Series) -> pd.Series:
        from tessera.operators import tile as T

        return pd.Series([T.W.blob(T.TILE_LAYER, T.layers(d)[0] + extra[k]) for d, k in zip(data, which, strict=True)])

    return run(F.col("data"), F.pmod(F.col("x") + F.col("y"), F.lit(len(extra))).cast("int"))


@query(_TILED + """SELECT x, y, CASE (x + y) % 7 WHEN 1 THEN 'layer_names' WHEN 2 THEN 'layer_unknown_field' WHEN 3 THEN 'layer_versions' WHEN 4 THEN 'feature_both,feature_type'
WHEN 5 THEN 'value_empty' WHEN 6 THEN 'feature_empty,feature_ids,bad_bytes' ELSE '' END AS codes, count(*) AS point, CAST((x + y) % 7 = 4 AS BIGINT) AS raster FROM u GROUP BY x, y""")
def validate_damaged(spark, sf):
    from tessera.operators import wire as W

    extra = [b"", W.blob(1, b"again"), W.uint(9, 1), W.uint(15, 2), W.blob(2, W.uint(3, 9) + W.blob(5, b"r") + W.blob(4, b"\x09\x02\x02")), W.blob(4, b""), W.blob(2, W.uint(1, 1) + W.uint(1, 2)) + b"\x12\x7f"]
    bad = customer_tiles(spark, sf).withColumn("data", _with(extra))
    return decode.errors(bad).select("x", "y", F.array_join("codes", ",").alias("codes"), "point", "raster")


@query(_TILED + "SELECT x, y, count(*) + 1 AS before, count(*) AS after FROM u GROUP BY 1, 2")
def clean_empty_features(spark, sf):
    """A feature without geometry is put into each tile and cleaned away."""
    from tessera.operators import wire as W

    tiles = customer_tiles(spark, sf).withColumn("data", _with([W.blob(2, W.uint(3, 1))]))
    before = decode.layer_headers(tiles).select("x", "y", F.col("n_features").alias("before"))
    after = decode.layer_headers(tiles.withColumn("data", decode.clean(F.col("data")))).select("x", "y", F.col("n_features").alias("after"))
    return before.join(after, ["x", "y"])


@query(_TILED + "SELECT x, y, count(*) FILTER (c_custkey % 2 = 0) AS n FROM u GROUP BY 1, 2 HAVING count(*) FILTER (c_custkey % 2 = 0) > 0")
def composite_first_wins(spark, sf):
    """The first source lies a zoom above and would be encoded anew; the second one's copy
    of the same layer comes before it."""
    c = customers(spark, sf)
    rows = c.select(point(F.col("mx"), F.col("my")).alias("geom"), F.col("c_custkey").alias("fid"))
    above = TileEncoder([LayerSpec("a", rows)]).encode(2).select("z", "x", "y", F.lit(0).alias("src"), "data")
    same = TileEncoder([LayerSpec("a", rows.where("fid % 2 = 0"))]).encode(3).select("z", "x", "y", F.lit(1).alias("src"), "data")
    targets = same.select("z", "x", "y", F.lit(None).cast("binary").alias("data"))
    return decode.layer_headers(combine.composite(targets, above.unionByName(same))).select("x", "y", F.col("n_features").alias("n"))


@query(_TILED + "SELECT x, y, count(*) FILTER (c_custkey % 2 = 0) AS n_a, count(*) AS n_b FROM u GROUP BY 1, 2 HAVING count(*) FILTER (c_custkey % 2 = 0) > 0")
def update_tiles(spark, sf):
    """Tiles hold layer a of the even customers; a and b of all are offered, a is skipped."""
    c = customers(spark, sf)
    rows = c.select(point(F.col("mx"), F.col("my")).alias("geom"), F.col("c_custkey").alias("fid"))
    own = TileEncoder([LayerSpec("a", rows.where("fid % 2 = 0"))]).encode(3).select("z", "x", "y", "data")
    found = combine.update(own, 3, TileEncoder([LayerSpec("a", rows), LayerSpec("b", rows)]))
    n = lambda name: F.sum(F.when(F.col("layer") == name, F.col("n_features"))).alias(f"n_{name}")
    return decode.layer_headers(found).groupBy("x", "y").agg(n("a"), n("b"))


@query(_TILED + "SELECT x, y, count(*) AS n_features FROM u WHERE gx BETWEEN 204800 AND 716800 AND gy BETWEEN 307200 AND 921600 GROUP BY 1, 2")
def encode_max_extent(spark, sf):
    """Customers as tiles, within a part of the world."""
    c = customers(spark, sf)
    rows = c.select(point(F.col("mx"), F.col("my")).alias("geom"), F.col("c_custkey").alias("fid"))
    cell = 2 * M.HALF / GRID
    box = (204800 * cell - M.HALF, M.HALF - 921600 * cell, 716800 * cell - M.HALF, M.HALF - 307200 * cell)
    return TileEncoder([LayerSpec("customers", rows)], EncodeOptions(max_extent=box)).encode(3).select("x", "y", "n_features")


@query("SELECT CAST(n_nationkey % 8 AS BIGINT) AS x, CAST(n_nationkey // 8 AS BIGINT) AS y, CAST(n_nationkey AS BIGINT) AS fid, CAST(64 AS BIGINT) AS n_pixels, CAST(4 * (16 * (7 * n_nationkey + 1) + 120) AS BIGINT) AS total, CAST(n_nationkey AS BIGINT) AS first_x, CAST(2 * n_nationkey AS BIGINT) AS first_y FROM nation")
def raster_tiles(spark, sf):
    """A raster of 4 x 4 pixels for each nation, shown at twice its size in a tile of its
    own: its pixels, their sum and the place of the first one."""
    from tessera.operators import raster as R

    k, side = F.col("n_nationkey"), 2 * M.HALF / 8
    left, top = k % 8 * side + k * (side / 256) - M.HALF, F.lit(M.HALF) - F.floor(k / 8) * side - k * (side / 128)
    pixels = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.lpad(F.hex((k * 7 + i + 1).cast("long")), 2, "0")), ""))
    source = read(spark, sf, "nation").select(k.alias("fid"), left.alias("minx"), (top - side / 32).alias("miny"), (left + side / 32).alias("maxx"), top.alias("maxy"), F.lit(4).alias("width"), F.lit(4).alias("height"), F.lit("gray8").alias("type"), pixels.alias("pixels"))

    @F.pandas_udf("n_pixels long, total long, first_x long, first_y long")
    def seen(images: pd.Series) -> pd.DataFrame:
        out = []
        for b in images:
            image = R.from_bytes(b)
            rows, columns = image.nonzero()
            out.append([len(rows), int(image.sum()), columns.min(), rows.min()])
        return pd.DataFrame(out, columns=["n_pixels", "total", "first_x", "first_y"], dtype="int64")

    found = decode.features(R.encode_rasters(source, "nations", 3, declared_extent=4096))
    return found.select("x", "y", "fid", seen("raster").alias("s")).select("x", "y", "fid", "s.*")


@query(_BOXES + """, s AS (SELECT p_partkey, greatest(x0, 0) / 16.0 AS a, (4096 - least(y0 + h, 4096)) / 16.0 AS b, least(x0 + w, 4096) / 16.0 AS c, (4096 - greatest(y0, 0)) / 16.0 AS d FROM b),
f AS (SELECT *, greatest(least(floor(a), 255), 0) AS xo, greatest(least(floor(b), 255), 0) AS yo FROM s WHERE c > a AND d > b)
SELECT p_partkey, CAST(xo AS INTEGER) AS x_off, CAST(yo AS INTEGER) AS y_off, CAST(greatest(least(ceil(c), 256) - xo, 1) AS INTEGER) AS width, CAST(greatest(least(ceil(d), 256) - yo, 1) AS INTEGER) AS height FROM f""")
def raster_window(spark, sf):
    """The pixels that boxes need of an image of 256 x 256 over a tile of 4096 x 4096."""
    from tessera.operators import raster as R

    tile = F.struct(*[F.lit(float(v)).alias(n) for n, v in (("minx", 0), ("miny", 0), ("maxx", 4096), ("maxy", 4096))])
    b = boxes(spark, sf).withColumn("w", R.window(tile, F.col("box"), F.lit(256), F.lit(256))).where("w is not null")
    return b.select("p_partkey", "w.x_off", "w.y_off", "w.width", "w.height")


@query(_TILED + "SELECT x, y, 'gzip' AS packed, 'zlib' AS deflated, 'none' AS plain, true AS same FROM u GROUP BY 1, 2")
def compress_round_trip(spark, sf):
    t = customer_tiles(spark, sf).withColumns({"g": codec.compress(F.col("data")), "d": codec.compress(F.col("data"), gzip=False)})
    same = (codec.decompress(F.col("g")) == F.col("data")) & (codec.decompress(F.col("d")) == F.col("data"))
    return t.select("x", "y", codec.sniff(F.col("g")).alias("packed"), codec.sniff(F.col("d")).alias("deflated"), codec.sniff(F.col("data")).alias("plain"), same.alias("same"))


@query()
def simplify_lines(spark, sf):
    """Order lines as tiles at zoom 2, simplified by four cells."""
    step = 2 * M.HALF / 80
    p = order_lines(spark, sf)
    line = F.transform("points", lambda q: F.struct((q["x"] * step - M.HALF).alias("x"), (F.lit(M.HALF) - q["y"] * step * 9).alias("y")))
    source = p.select(geometry("linestring", F.array(F.array(line))).alias("geom"), F.col("l_orderkey").alias("fid"))
    tiles = TileEncoder([LayerSpec("orders", source)], EncodeOptions(simplify_distance=4)).encode(2)
    return decode.tile_info(tiles).select("x", "y", "n_features", "n_line")


@query(_TILED + "SELECT x, y, 'customers' AS layer, 2 AS version, count(*) AS n_features FROM u GROUP BY 1, 2")
def upgrade_v1(spark, sf):
    """Tiles marked as version 1, brought to version 2."""
    old = customer_tiles(spark, sf).withColumn("data", decode.set_version(F.col("data"), 1))
    return decode.layer_headers(combine.upgrade(old)).select("x", "y", "layer", "version", "n_features")
