"""Geometries as (kind, parts): command streams, clipping and simplification.

parts is a list of lists of point lists: polygons of rings; one list of lines; one list
of one list of points."""

from __future__ import annotations

import math

from tessera.operators import overlay
from tessera.operators.wire import BadTile

Point = tuple[float, float]
Box = tuple[float, float, float, float]
EMPTY = ("empty", [])
FILL_RULES = ("even_odd", "non_zero", "positive", "negative")


# -- commands ---------------------------------------------------------------------


def zigzag(n: int) -> int:
    """Of a number narrowed to 32 bits, as the format has it."""
    n = (n + 0x80000000 & 0xFFFFFFFF) - 0x80000000
    return (n << 1 ^ n >> 31) & 0xFFFFFFFF


def unzigzag(n: int) -> int:
    n &= 0xFFFFFFFF
    return n >> 1 ^ -(n & 1)


def distinct(points: list[Point]) -> list[Point]:
    return [p for i, p in enumerate(points) if i == 0 or p != points[i - 1]]


class Encoder:
    """Commands of one geometry; the cursor stays between its parts."""

    def __init__(self):
        self.out: list[int] = []
        self.x = self.y = 0

    def _move(self, p: Point) -> None:
        self.out += [zigzag(int(p[0]) - self.x), zigzag(int(p[1]) - self.y)]
        self.x, self.y = int(p[0]), int(p[1])

    def points(self, points: list[Point]) -> bool:
        if not points:
            return False
        self.out.append(1 | len(points) << 3)
        for p in points:
            self._move(p)
        return True

    def line(self, points: list[Point]) -> bool:
        points = distinct(points)
        if len(points) < 2:
            return False
        self.out.append(9)
        self._move(points[0])
        self.out.append(2 | len(points) - 1 << 3)
        for p in points[1:]:
            self._move(p)
        return True

    def ring(self, points: list[Point]) -> bool:
        points = distinct(points)
        if len(points) > 1 and points[0] == points[-1]:
            points = points[:-1]
        if len(points) < 3:
            return False
        self.line(points)
        self.out.append(15)
        return True

    def polygon(self, rings: list[list[Point]]) -> bool:
        if not rings or not self.ring(rings[0]):
            return False
        for r in rings[1:]:
            self.ring(r)
        return True


def encode(geom: tuple[str, list]) -> tuple[int, list[int]] | None:
    """(type, commands), or None for a degenerate geometry."""
    kind, parts = geom
    e = Encoder()
    if kind == "empty":
        return None
    if kind in ("point", "multipoint"):
        ok, gtype = e.points(parts[0][0] if parts and parts[0] else []), 1
    elif kind in ("linestring", "multilinestring"):
        ok, gtype = any([e.line(p) for part in parts for p in part]), 2
    elif kind in ("polygon", "multipolygon"):
        ok, gtype = any([e.polygon(p) for p in parts]), 3
    else:
        raise ValueError(f"a {kind} has no commands")
    return (gtype, e.out) if ok else None


def _commands(cmds: list[int]):
    """(command, points) in turn; nothing is reserved by what a count claims."""
    i = x = y = 0
    while i < len(cmds):
        which, count = cmds[i] & 7, cmds[i] >> 3
        i += 1
        if which == 7:
            yield 7, []
            continue
        if which not in (1, 2):
            raise BadTile(f"unknown command {which}")
        if count < 1:
            raise BadTile("a command without points")
        points = []
        for _ in range(count):
            if i + 1 >= len(cmds):
                raise BadTile("end of data in a command")
            x, y = x + unzigzag(cmds[i]), y + unzigzag(cmds[i + 1])
            i += 2
            points.append((x, y))
        yield which, points


def area2(ring: list[Point]) -> float:
    """Twice the area; positive if counter-clockwise with y up."""
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))


def _meets(points: list[Point], box: Box | None) -> bool:
    if box is None:
        return True
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    return min(xs) <= box[2] and max(xs) >= box[0] and min(ys) <= box[3] and max(ys) >= box[1]


def decode(cmds: list[int], gtype: int, version: int = 2, origin: Point = (0, 0), scale: tuple[float, float] = (1, 1), bbox: Box | None = None, whole: bool = False) -> tuple[str, list]:
    """The geometry of a command stream. Version 2 is strict where version 1 forgives.

    Values are origin + v / scale, rounded for ``whole`` coordinates. With a box, single
    points outside, lines whose envelope misses it and rings likewise are left out; the
    holes of an exterior left out go with it."""

    def place(p: Point) -> Point:
        dx, dy = p[0] / scale[0], p[1] / scale[1]
        if whole:
            dx, dy = (math.copysign(math.floor(abs(d) + 0.5), d) for d in (dx, dy))
            return int(origin[0] + dx), int(origin[1] + dy)
        return origin[0] + dx, origin[1] + dy

    strict = version >= 2
    if gtype == 1:
        points = []
        for which, own in _commands(cmds):
            if which != 1:
                raise BadTile("a point with a command other than MoveTo")
            points += [q for q in map(place, own) if _meets([q], bbox)]
        return EMPTY if not points else ("point" if len(points) == 1 else "multipoint", [[points]])
    if gtype == 2:
        lines, start, fresh = [], None, False
        for which, own in _commands(cmds):
            if which == 1:
                if len(own) != 1:
                    raise BadTile("a line's MoveTo with several points")
                if fresh and strict:
                    raise BadTile("a MoveTo behind a MoveTo")
                start, fresh = own[0], True
            elif which == 2:
                if start is None:
                    raise BadTile("a line without MoveTo")
                if fresh:
                    lines.append([start])
                lines[-1] += own
                fresh = False
            else:
                raise BadTile("a line with ClosePath")
        if fresh and strict:
            raise BadTile("a MoveTo at the end")
        kept = [q for q in ([place(p) for p in distinct(r)] for r in lines) if len(q) > 1 and _meets(q, bbox)]
        return EMPTY if not kept else ("linestring" if len(kept) == 1 else "multilinestring", [kept])
    if gtype == 3:
        return _decode_rings(cmds, strict, place, scale, bbox)
    return EMPTY


def _decode_rings(cmds, strict, place, scale, bbox) -> tuple[str, list]:
    polygons: list[list[list[Point]]] = []
    ring: list[Point] | None = None
    first_clockwise = None
    open_exterior = False
    for which, own in _commands(cmds):
        if which == 1:
            if len(own) != 1:
                raise BadTile("a ring's MoveTo with several points")
            if ring is not None:
                raise BadTile("a ring that is not closed")
            ring = [own[0]]
        elif which == 2:
            if ring is None:
                raise BadTile("a ring without MoveTo")
            ring += own
        else:
            if ring is None:
                raise BadTile("a ClosePath without ring")
            points, ring = distinct(ring), None
            if len(points) < 2 or (len(points) == 2 and strict):
                if strict:
                    raise BadTile("a ring of fewer than three points")
                continue
            if points[0] != points[-1]:
                points.append(points[0])
            if len(points) < 4:
                continue  # its holes go to the polygon before
            clockwise = area2(points) < 0  # a ring without area is not
            if first_clockwise is None:
                if clockwise and strict:
                    raise BadTile("the first ring is clockwise")
                first_clockwise = clockwise
            placed = [place(p) for p in points]
            if (scale[0] * scale[1] < 0) != first_clockwise:
                placed.reverse()
            if clockwise == first_clockwise:
                open_exterior = _meets(placed, bbox)
                if open_exterior:
                    polygons.append([placed])
            elif open_exterior and polygons and _meets(placed, bbox):
                polygons[-1].append(placed)
    if ring is not None:
        raise BadTile("a ring that is not closed")
    return EMPTY if not polygons else ("polygon" if len(polygons) == 1 else "multipolygon", polygons)


# -- simplification ---------------------------------------------------------------


def douglas_peucker(points: list[Point], distance: float) -> list[Point]:
    """Points farther from their segment than the distance stay; the first farthest wins."""
    if len(points) < 3:
        return list(points)
    keep = {0, len(points) - 1}
    spans = [(0, len(points) - 1)]
    limit = distance * distance
    while spans:
        a, b = spans.pop()
        (ax, ay), (bx, by) = points[a], points[b]
        dx, dy = bx - ax, by - ay
        size = dx * dx + dy * dy
        far, at = limit, None
        for i in range(a + 1, b):
            px, py = points[i][0] - ax, points[i][1] - ay
            t = min(1.0, max(0.0, (px * dx + py * dy) / size)) if size else 0.0
            d = (px - t * dx) ** 2 + (py - t * dy) ** 2
            if d > far:
                far, at = d, i
        if at is not None:
            keep.add(at)
            spans += [(a, at), (at, b)]
    return [points[i] for i in sorted(keep)]


def simplify(geom: tuple[str, list], distance: float) -> tuple[str, list]:
    """Lines of two points and rings of four stay as they are; the distance counts in
    whole units, so one half takes out points on a straight line only."""
    kind, parts = geom
    d = float(int(distance))
    if kind in ("linestring", "multilinestring"):
        return kind, [[p if len(p) <= 2 else douglas_peucker(p, d) for p in part] for part in parts]
    if kind in ("polygon", "multipolygon"):
        return kind, [[r if len(r) <= 4 else douglas_peucker(r, d) for r in part] for part in parts]
    return geom


# -- clipping ---------------------------------------------------------------------


def _half_up(v: float) -> int:
    return int(math.copysign(math.floor(abs(v) + 0.5), v))


def clip_line(points: list[Point], box: Box) -> list[list[Point]]:
    """The parts of a line within a box, on whole coordinates."""
    out: list[list[Point]] = []
    for (ax, ay), (bx, by) in zip(points, points[1:], strict=False):
        t0, t1, dx, dy = 0.0, 1.0, bx - ax, by - ay
        for p, q in ((-dx, ax - box[0]), (dx, box[2] - ax), (-dy, ay - box[1]), (dy, box[3] - ay)):
            if p == 0:
                if q < 0:
                    t0, t1 = 1.0, 0.0
                    break
            elif p < 0:
                t0 = max(t0, q / p)
            else:
                t1 = min(t1, q / p)
        if t0 > t1:
            continue
        a = (ax, ay) if t0 == 0 else (_half_up(ax + t0 * dx), _half_up(ay + t0 * dy))
        b = (bx, by) if t1 == 1 else (_half_up(ax + t1 * dx), _half_up(ay + t1 * dy))
        if out and out[-1][-1] == a:
            out[-1].append(b)
        else:
            out.append([a, b])
    return [q for q in map(distinct, out) if len(q) > 1]


def clip_ring(ring: list[Point], box: Box) -> list[Point]:
    """A ring cut to a box side by side, closed; empty if nothing is left."""
    points = distinct(ring)
    if points and points[0] == points[-1]:
        points = points[:-1]
    sides = ((0, box[0], 1), (0, box[2], -1), (1, box[1], 1), (1, box[3], -1))
    for axis, limit, sign in () if all(box[0] <= x <= box[2] and box[1] <= y <= box[3] for x, y in points) else sides:
        out: list[Point] = []
        for i, b in enumerate(points):
            a = points[i - 1]
            ina, inb = sign * (a[axis] - limit) >= 0, sign * (b[axis] - limit) >= 0
            if ina != inb:
                t = (limit - a[axis]) / (b[axis] - a[axis])
                other = _half_up(a[1 - axis] + t * (b[1 - axis] - a[1 - axis]))
                out.append((limit, other) if axis == 0 else (other, limit))
            if inb:
                out.append(b)
        points = out
    points = distinct(points)
    if points and points[0] == points[-1]:
        points = points[:-1]
    return [*points, points[0]] if len(points) > 2 else []


def clip(geom: tuple[str, list], box: Box, area_threshold: float = 0.1, process_all_rings: bool = False, fill: str = "positive", union: bool = False) -> tuple[str, list]:
    """A geometry within a box. Points pass; repeated neighbours of a multipoint go.

    Exteriors are made counter-clockwise and holes clockwise and cut to the box; what the
    fill rule has inside a polygon's rings, or with ``union`` inside those of all polygons,
    is the result, as polygons whose rings neither cross nor overlap. An exterior below
    the area threshold, or outside the box, takes its polygon along unless all rings are
    processed; a hole below it goes."""
    kind, parts = geom
    if kind == "multipoint":
        return kind, [[distinct(p) for p in part] for part in parts]
    if kind in ("linestring", "multilinestring"):
        kept = [q for part in parts for p in part for q in clip_line(distinct(p), box)]
        return ("multilinestring", [kept]) if kept else EMPTY
    if kind in ("polygon", "multipolygon"):
        if fill not in FILL_RULES:
            raise ValueError(f"no fill rule {fill}")
        polygons: list[list[list[Point]]] = []
        for rings in parts:
            own: list[list[Point]] = []
            for i, r in enumerate(rings):
                thin = len(distinct(r)) < 4
                size = 0 if thin else area2(r)
                small = thin or abs(size) / 2 < area_threshold
                c = [] if thin or (small and not (i == 0 and process_all_rings)) else clip_ring(r if (size >= 0) == (i == 0) else r[::-1], box)
                if i == 0 and not c and not process_all_rings:
                    break
                if c:
                    own.append(c)
            polygons.append(own)
        out = []
        for own in [[r for p in polygons for r in p]] if union else polygons:
            if len(own) == 1 and fill != "negative" and area2(own[0]) > 0 and overlay.is_convex(own[0]):
                out.append(own)  # nothing to be cut or joined
            else:
                out += overlay.union(own, fill)
        return ("multipolygon", out) if out else EMPTY
    return geom
