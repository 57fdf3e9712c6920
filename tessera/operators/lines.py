"""Lines to a tile's commands, a batch of rows at a time: on arrays, what geometry.py does
with one line. Rows whose numbers it can't take exactly are left to geometry.py."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed value: below it every product and quotient here is exact in 64 bits and a double.
EXACT = 2.0**25
LINES = pa.array(["linestring", "multilinestring"])


def half_up(v: np.ndarray) -> np.ndarray:
    return np.copysign(np.floor(np.abs(v) + 0.5), v).astype(np.int64)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each of some ranges, one behind the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def firsts(own: np.ndarray) -> np.ndarray:
    """Where a value begins in an array of values that stand together."""
    first = np.ones(len(own), bool)
    first[1:] = own[1:] != own[:-1]
    return first


def varint_sizes(v: np.ndarray) -> np.ndarray:
    size = np.ones(len(v), np.int64)
    for bits in range(7, 64, 7):
        size += v >= np.uint64(1 << bits)
    return size


def put_varints(out: np.ndarray, at: np.ndarray, v: np.ndarray, size: np.ndarray) -> None:
    """Numbers (uint64) as varints at their places in bytes."""
    for k in range(int(size.max(initial=0))):
        own = size > k
        more = np.where(size[own] > k + 1, 128, 0).astype(np.uint8)
        out[at[own] + k] = (v[own] >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8) | more


def simplified(x: np.ndarray, y: np.ndarray, first: np.ndarray, last: np.ndarray, distance: float) -> np.ndarray:
    """Which points Douglas and Peucker's way keeps of lines from ``first`` to ``last``."""
    keep = np.zeros(len(x), bool)
    keep[first] = keep[last] = True
    a, b, limit = first, last, distance * distance
    while True:
        inner = b - a > 1
        a, b = a[inner], b[inner]
        if not len(a):
            return keep
        own, i = np.repeat(np.arange(len(a)), b - a - 1), ranges(a + 1, b - a - 1)
        px, py, dx, dy = x[i] - x[a][own], y[i] - y[a][own], (x[b] - x[a])[own], (y[b] - y[a])[own]
        size = dx * dx + dy * dy
        t = np.clip(np.divide(px * dx + py * dy, size, out=np.zeros(len(i)), where=size != 0), 0.0, 1.0)
        ex, ey, start = px - t * dx, py - t * dy, np.flatnonzero(firsts(own))
        d = ex * ex + ey * ey
        most = np.maximum.reduceat(d, start)
        # powers of Python's floats differ from products in the last bit: ties are settled by them
        tied = np.flatnonzero((d >= most[own] * (1 - 1e-9)) & (most[own] > 0))
        close = (np.bincount(own[tied], minlength=len(a)) > 1) | (np.abs(most - limit) <= 1e-9 * limit)
        tied = tied[(close & (most >= limit * (1 - 1e-9)))[own[tied]]]
        d[tied] = [p**2 + q**2 for p, q in zip(ex[tied].tolist(), ey[tied].tolist(), strict=True)]
        most = np.maximum.reduceat(d, start)
        top = np.flatnonzero(d == most[own])
        at = i[top[firsts(own[top])]]
        hit = most > limit
        a, b, at = a[hit], b[hit], at[hit]
        keep[at] = True
        a, b = np.concatenate([a, at]), np.concatenate([at, b])


def _flat(geom: pa.StructArray):
    """(lines of each row, points of each line, x, y), or None where something is null."""
    if geom.null_count:
        return None
    sizes, values = [], geom.flatten()[1]
    for _ in range(3):
        if values.null_count:
            return None
        sizes.append(np.diff(values.offsets.to_numpy()))
        values = values.flatten()
    if values.null_count:
        return None
    x, y = values.flatten()
    if x.null_count or y.null_count:
        return None
    ends = np.concatenate([[0], np.cumsum(sizes[1])])
    parts = np.concatenate([[0], np.cumsum(sizes[0])])
    return np.diff(ends[parts]), sizes[2], x.to_numpy(), y.to_numpy()


def encode(geom: pa.StructArray, left, top, box, edge, per_unit: float, offset_x: int, offset_y: int, distance: float) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(rows that are done, rows that have a code, those codes: type and geometry fields).

    ``left``, ``top``, the sides of ``box`` (map units) and of ``edge`` (cells) are arrays,
    one number a row."""
    none = np.empty(0, np.int64), pa.array([], pa.binary())
    rows = np.flatnonzero(pc.is_in(geom.field("kind"), LINES).to_numpy(zero_copy_only=False))
    flat = _flat(geom.take(pa.array(rows))) if len(rows) else None
    if flat is None:
        return np.empty(0, np.int64), *none
    per_row, per_line, px, py = flat
    row = np.repeat(rows, per_row)[per_line > 0]
    size = per_line[per_line > 0].astype(np.int64)
    hard = np.zeros(len(geom), bool)
    hard[np.repeat(row, size)[~(np.isfinite(px) & np.isfinite(py))]] = True
    if len(row):
        at = np.cumsum(size) - size
        low, high = (np.minimum.reduceat(px, at), np.minimum.reduceat(py, at)), (np.maximum.reduceat(px, at), np.maximum.reduceat(py, at))
        meets = (low[0] <= box[2][row]) & (high[0] >= box[0][row]) & (low[1] <= box[3][row]) & (high[1] >= box[1][row]) & ~hard[row]
        held = np.repeat(meets, size)
        px, py, row, size = px[held], py[held], row[meets], size[meets]
    own = np.repeat(row, size)
    gx, gy = (px - left[own]) * per_unit - offset_x, (top[own] - py) * per_unit - offset_y
    hard[own[(np.abs(gx) >= EXACT) | (np.abs(gy) >= EXACT)]] = True
    fine = ~hard[row]
    held = np.repeat(fine, size)
    gx, gy, row, size = half_up(gx[held]), half_up(gy[held]), row[fine], size[fine]
    done = rows[~hard[rows]]
    if not len(row):
        return done, *none
    line = np.repeat(np.arange(len(row)), size)
    if distance > 0:
        first = np.cumsum(size) - size
        kept = simplified(gx, gy, first, first + size - 1, float(int(distance)))
        gx, gy, line = gx[kept], gy[kept], line[kept]
    kept = firsts(line)
    kept[1:] |= (gx[1:] != gx[:-1]) | (gy[1:] != gy[:-1])
    gx, gy, line = gx[kept], gy[kept], line[kept]

    i = np.flatnonzero(line[1:] == line[:-1])  # pieces from a point to the next, cut to the box
    ax, ay, dx, dy, line = gx[i], gy[i], gx[i + 1] - gx[i], gy[i + 1] - gy[i], line[i]
    t0, t1, off = np.zeros(len(i)), np.ones(len(i)), np.zeros(len(i), bool)
    e = [side[row[line]] for side in edge]
    for p, q in ((-dx, ax - e[0]), (dx, e[2] - ax), (-dy, ay - e[1]), (dy, e[3] - ay)):
        t = np.divide(q, p, out=np.zeros(len(p)), where=p != 0)
        off |= (p == 0) & (q < 0)
        t0, t1 = np.where(p < 0, np.maximum(t0, t), t0), np.where(p > 0, np.minimum(t1, t), t1)
    ins = ~off & (t0 <= t1)
    ax, ay, dx, dy, line, t0, t1 = (v[ins] for v in (ax, ay, dx, dy, line, t0, t1))
    x0, y0 = np.where(t0 == 0, ax, half_up(ax + t0 * dx)), np.where(t0 == 0, ay, half_up(ay + t0 * dy))
    x1, y1 = np.where(t1 == 1, ax + dx, half_up(ax + t1 * dx)), np.where(t1 == 1, ay + dy, half_up(ay + t1 * dy))
    new = firsts(line)
    new[1:] |= (x0[1:] != x1[:-1]) | (y0[1:] != y1[:-1])
    if not len(line):
        return done, *none

    count = 1 + new.astype(np.int64)  # a part begins with both ends of its first piece
    last = np.cumsum(count) - 1
    x, y, part = (np.empty(int(count.sum()), np.int64) for _ in range(3))
    x[last], y[last], part[last] = x1, y1, np.cumsum(new) - 1
    x[last[new] - 1], y[last[new] - 1], part[last[new] - 1] = x0[new], y0[new], np.arange(int(new.sum()))
    row = row[line[new]]
    kept = firsts(part)
    kept[1:] |= (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    x, y, part = x[kept], y[kept], part[kept]
    long = np.bincount(part, minlength=len(row)) > 1
    x, y, part = x[long[part]], y[long[part]], (np.cumsum(long) - 1)[part[long[part]]]
    row = row[long]
    if not len(row):
        return done, *none

    # each row's numbers: the fields' keys, type and size; then 9, a point, the count of the others, they
    of = row[part]
    start = firsts(of)
    step = []
    for v in (x, y):
        d = v.copy()
        d[1:] -= np.where(start[1:], 0, v[:-1])
        step.append(np.where(d < 0, -2 * d - 1, 2 * d).astype(np.uint64))
    n = np.bincount(part).astype(np.int64)
    coded = row[firsts(row)]
    head = firsts(row)
    width = 2 + 2 * n + 4 * head
    begin = np.cumsum(width) - width + 4 * head
    v = np.empty(int(width.sum()), np.uint64)
    v[begin], v[begin + 3] = 9, (2 | n - 1 << 3).astype(np.uint64)
    k = np.arange(len(part)) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(begin, n) + np.where(k == 0, 1, 2 + 2 * k)
    v[at], v[at + 1] = step
    heads = begin[head] - 4
    v[heads], v[heads + 1], v[heads + 2], v[heads + 3] = 24, 2, 34, 0
    bytes_of = varint_sizes(v)
    total = np.add.reduceat(bytes_of, heads)
    v[heads + 3] = total - 4
    bytes_of[heads + 3] = varint_sizes(v[heads + 3])
    ends = np.cumsum(bytes_of)
    out = np.empty(int(ends[-1]), np.uint8)
    put_varints(out, ends - bytes_of, v, bytes_of)
    offsets = np.concatenate([(ends - bytes_of)[heads], ends[-1:]]).astype(np.int32)
    return done, coded, pa.Array.from_buffers(pa.binary(), len(coded), [None, pa.py_buffer(offsets), pa.py_buffer(out)])
