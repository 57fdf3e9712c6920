"""Geometry command streams as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOVE, LINE, CLOSE = 1, 2, 7


def command(which: int, count: Column) -> Column:
    return F.shiftleft(count.cast("long"), 3).bitwiseOR(F.lit(which))


def zigzag(n: Column) -> Column:
    n = n.cast("long")
    return F.shiftleft(n, 1).bitwiseXOR(F.shiftright(n, 63))


def unzigzag(n: Column) -> Column:
    n = n.cast("long")
    return F.shiftrightunsigned(n, 1).bitwiseXOR(-n.bitwiseAND(F.lit(1)))


def dedupe(points: Column) -> Column:
    """Without points that repeat the one before them."""
    return F.filter(points, lambda p, i: (i == 0) | ~F.coalesce(p.eqNullSafe(F.get(points, i - 1)), F.lit(False)))


def repeats(points: Column) -> Column:
    """How many points repeat the one before them."""
    return F.size(points) - F.size(dedupe(points))


def _deltas(points: Column) -> Column:
    def step(p: Column, i: Column) -> Column:
        before = F.get(points, i - 1)
        return F.array(zigzag(p["x"] - F.when(i == 0, F.lit(0)).otherwise(before["x"])), zigzag(p["y"] - F.when(i == 0, F.lit(0)).otherwise(before["y"])))

    return F.transform(points, step)


def encode_points(points: Column) -> Column:
    """One MoveTo of all points, repeated ones too; null if there are none."""
    return F.when(F.size(points) > 0, F.concat(F.array(command(MOVE, F.size(points))), F.flatten(_deltas(points))))


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _path(own: Column, least: int, end: Column) -> Column:
    return F.when(F.size(own) >= least, let(_deltas(own), lambda d: F.concat(F.array(command(MOVE, F.lit(1))), F.element_at(d, 1), F.array(command(LINE, F.size(own) - 1)), F.flatten(F.slice(d, F.lit(2), F.size(own) - 1)), end)))


def encode_line(points: Column) -> Column:
    """Null with fewer than two points that differ from the one before."""
    return let(dedupe(points), lambda own: _path(own, 2, F.array().cast("array<bigint>")))


def open_ring(points: Column) -> Column:
    """Without repeats and without the closing point."""

    def opened(own: Column) -> Column:
        closed = (F.size(own) > 1) & F.try_element_at(own, F.lit(1)).eqNullSafe(F.try_element_at(own, F.lit(-1)))
        return F.when(closed, F.slice(own, F.lit(1), F.greatest(F.size(own) - 1, F.lit(0)))).otherwise(own)

    return let(dedupe(points), opened)


def encode_ring(points: Column) -> Column:
    """Null with fewer than three points."""
    return let(open_ring(points), lambda own: _path(own, 3, F.array(F.lit(15).cast("long"))))


def decode_points(cmds: Column) -> Column:
    """array of struct(x, y) of a MoveTo of one or more points."""
    start = F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.array().cast("array<struct<x:bigint,y:bigint>>").alias("out"))
    pairs = F.transform(F.sequence(F.lit(1), (F.size(cmds) - 1).cast("int"), F.lit(2)), lambda i: F.struct(unzigzag(F.get(cmds, i)).alias("dx"), unzigzag(F.get(cmds, i + 1)).alias("dy")))

    def add(s: Column, d: Column) -> Column:
        x, y = s["x"] + d["dx"], s["y"] + d["dy"]
        return F.struct(x.alias("x"), y.alias("y"), F.concat(s["out"], F.array(F.struct(x.alias("x"), y.alias("y")))).alias("out"))

    return F.when(F.size(cmds) >= 3, F.aggregate(pairs, start, add, lambda s: s["out"])).otherwise(F.array().cast("array<struct<x:bigint,y:bigint>>"))


def ring_area2(points: Column) -> Column:
    """Twice the signed area of a closed ring; positive if counter-clockwise with y up."""
    nxt = F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0)))
    return F.aggregate(F.zip_with(F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0))), nxt, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0).cast("long"), lambda s, v: s + v)


def envelope(points: Column) -> Column:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


def box_ring(box: Column) -> Column:
    """The five points of a box, closed."""
    corner = lambda x, y: F.struct(box[x].alias("x"), box[y].alias("y"))
    return F.array(corner("minx", "miny"), corner("maxx", "miny"), corner("maxx", "maxy"), corner("minx", "maxy"), corner("minx", "miny"))


def wire_type(v: Column) -> Column:
    """float where a double is exact as one, else double (NaN too)."""
    return F.when(v.cast("float").cast("double") == v, F.when(F.isnan(v), "double").otherwise("float")).otherwise("double")
