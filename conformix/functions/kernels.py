"""Exact plane measurements of entity pairs over Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import functions as F

from conformix.schema import CIRCLE_VERTICES

EPS = 1e-9


def _turn(ax, ay, bx, by, cx, cy):
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def _nearest(px, py, ax, ay, bx, by):
    dx, dy = bx - ax, by - ay
    l2 = dx * dx + dy * dy
    t = np.clip(((px - ax) * dx + (py - ay) * dy) / np.where(l2 > 0, l2, 1), 0, 1) * (l2 > 0)
    return ax + t * dx, ay + t * dy


def touches(ax, ay, bx, by, cx, cy, dx, dy):
    """Segments ab and cd share a point, with a tolerance that grows with coordinates and lengths."""
    t = EPS * np.maximum.reduce([np.ones_like(ax), *map(np.abs, (ax, ay, bx, by, cx, cy, dx, dy))])
    w = t * np.maximum.reduce([np.ones_like(ax), np.hypot(bx - ax, by - ay), np.hypot(dx - cx, dy - cy)])
    o1, o2, o3, o4 = _turn(ax, ay, bx, by, cx, cy), _turn(ax, ay, bx, by, dx, dy), _turn(cx, cy, dx, dy, ax, ay), _turn(cx, cy, dx, dy, bx, by)

    def sides(p, q):
        return ((p > w) & (q < -w)) | ((p < -w) & (q > w))

    def on(sx, sy, ex, ey, px, py):
        return (np.minimum(sx, ex) - t <= px) & (px <= np.maximum(sx, ex) + t) & (np.minimum(sy, ey) - t <= py) & (py <= np.maximum(sy, ey) + t)

    hit = sides(o1, o2) & sides(o3, o4)
    for o, seg, p in ((o1, (ax, ay, bx, by), (cx, cy)), (o2, (ax, ay, bx, by), (dx, dy)), (o3, (cx, cy, dx, dy), (ax, ay)), (o4, (cx, cy, dx, dy), (bx, by))):
        hit = hit | (np.abs(o) <= w) & on(*seg, *p)
    return hit, t


def segment_pairs(ax, ay, bx, by, cx, cy, dx, dy):
    """d, pax, pay, pbx, pby of segments ab and cd."""
    hit, t = touches(ax, ay, bx, by, cx, cy, dx, dy)
    drops = (((ax, ay), (cx, cy, dx, dy)), ((bx, by), (cx, cy, dx, dy)), ((cx, cy), (ax, ay, bx, by)), ((dx, dy), (ax, ay, bx, by)))
    feet = [_nearest(*p, *seg) for p, seg in drops]
    d = np.stack([np.hypot(p[0] - q[0], p[1] - q[1]) for (p, _), q in zip(drops, feet)])
    k, rows = d.argmin(axis=0), np.arange(len(ax))
    own = [np.stack([p[i] for p, _ in drops])[k, rows] for i in (0, 1)]
    foot = [np.stack([q[i] for q in feet])[k, rows] for i in (0, 1)]
    den = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
    flat = np.abs(den) < 1e-15
    m = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / np.where(flat, 1, den)
    near = d <= 10 * t
    out = [np.where(hit, 0.0, d[k, rows])]
    for side in (k < 2, k >= 2):
        for i, (a, b, c, e) in enumerate(((ax, bx, cx, dx), (ay, by, cy, dy))):
            shared = np.select([~flat, near[2], near[3], near[0], near[1]], [a + m * (b - a), c, e, a, b], a)
            out.append(np.where(hit, shared, np.where(side, own[i], foot[i])))
    return out


def _toward(cx, cy, px, py, r):
    d = np.hypot(px - cx, py - cy)
    safe = np.where(d > 0, d, 1)
    return np.where(d > 0, cx + (px - cx) / safe * r, cx + r), np.where(d > 0, cy + (py - cy) / safe * r, cy)


def rim_segments(cx, cy, r, ax, ay, bx, by):
    """d, point on the rim, point on the segment, of circles and segments ab."""
    qx, qy = _nearest(cx, cy, ax, ay, bx, by)
    dmin, da, db = np.hypot(cx - qx, cy - qy), np.hypot(ax - cx, ay - cy), np.hypot(bx - cx, by - cy)
    dmax, dx, dy, fx, fy = np.maximum(da, db), bx - ax, by - ay, ax - cx, ay - cy
    a, b, c = dx * dx + dy * dy, 2 * (fx * dx + fy * dy), fx * fx + fy * fy - r * r
    root, two = np.sqrt(np.maximum(0, b * b - 4 * a * c)), np.where(a > 0, 2 * a, 1)
    t0, t1 = (-b - root) / two, (-b + root) / two
    ok0, ok1 = (a > 0) & (t0 >= 0) & (t0 <= 1), (a > 0) & (t1 >= 0) & (t1 <= 1)
    t = np.where(ok0, t0, t1)
    far, inner = dmin >= r, dmax <= r
    sx = np.select([far, inner, ok0 | ok1], [qx, np.where(da >= db, ax, bx), ax + t * dx], qx)
    sy = np.select([far, inner, ok0 | ok1], [qy, np.where(da >= db, ay, by), ay + t * dy], qy)
    rx, ry = _toward(cx, cy, sx, sy, r)
    cross = ~far & ~inner
    return [np.select([far, inner], [dmin - r, r - dmax], 0.0), np.where(cross, sx, rx), np.where(cross, sy, ry), sx, sy]


def rim_rims(ax, ay, ra, bx, by, rb):
    d, low, high = np.hypot(ax - bx, ay - by), np.minimum(ra, rb), np.maximum(ra, rb)
    apart, inner = d >= ra + rb, d + low <= high
    pa_, pb = _toward(ax, ay, bx, by, ra), _toward(bx, by, ax, ay, rb)
    out = [np.select([apart, inner], [d - ra - rb, high - d - low], 0.0)]
    for p, c, large in ((pa_, (ax, ay), ra >= rb), (pb, (bx, by), rb > ra)):
        for i in (0, 1):
            out.append(np.select([apart, inner], [p[i], np.where(large, p[i], c[i])], pa_[i]))
    return out


class Shapes:
    """A struct column of entities as arrays; segments and vertices of any of them."""

    def __init__(self, column: pa.StructArray):
        get = dict(zip([f.name for f in column.type], column.flatten()))
        num = lambda n: get[n].to_numpy(zero_copy_only=False).astype(float)
        self.kind = np.array(get["kind"].to_pylist(), object)
        self.circle, self.text = self.kind == "circle", self.kind == "text"
        self.cx, self.cy, self.r = num("cx"), num("cy"), num("radius")
        self.box = [num(n) for n in ("minx", "miny", "maxx", "maxy")]
        self.closed = self.circle | np.array([bool(x) for x in get["closed"].to_pylist()])
        points = get["points"]
        self.count = np.array([0 if n is None else n for n in pa.compute.list_value_length(points).to_pylist()])
        flat = points.flatten()
        self.x, self.y = (c.to_numpy(zero_copy_only=False) for c in flat.flatten())
        self.first = np.concatenate(([0], np.cumsum(self.count)))

    def move(self, x: np.ndarray, y: np.ndarray) -> None:
        """Takes an origin of its own from every entity."""
        self.cx, self.cy = self.cx - x, self.cy - y
        self.box = [b - o for b, o in zip(self.box, (x, y, x, y))]
        self.x, self.y = self.x - np.repeat(x, self.count), self.y - np.repeat(y, self.count)

    def vertices(self, i: int) -> np.ndarray:
        if self.circle[i]:
            a = 2 * np.pi * np.arange(CIRCLE_VERTICES) / CIRCLE_VERTICES
            return np.stack((self.cx[i] + self.r[i] * np.cos(a), self.cy[i] + self.r[i] * np.sin(a)), axis=1)
        if self.text[i]:
            return np.array([[self.cx[i], self.cy[i]]])
        s = slice(self.first[i], self.first[i + 1])
        return np.stack((self.x[s], self.y[s]), axis=1)

    def segments(self, i: int) -> np.ndarray:
        """Rows ax, ay, bx, by."""
        v = self.vertices(i)
        if len(v) == 1:
            return np.concatenate((v, v), axis=1)
        out = np.concatenate((v[:-1], v[1:]), axis=1)
        if self.closed[i] and len(v) > 2 and (v[0] != v[-1]).any():
            out = np.concatenate((out, np.concatenate((v[-1:], v[:1]), axis=1)))
        return out

    def lines(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in rows, segment) of all segments of entities that are no circles; two-point lines go all at once."""
        two = (self.count[rows] == 2) & ~self.text[rows]
        at = self.first[rows[two]]
        owner, seg = [np.flatnonzero(two)], [np.stack((self.x[at], self.y[at], self.x[at + 1], self.y[at + 1]), axis=1)] if two.any() else [np.zeros((0, 4))]
        for k in np.flatnonzero(~two):
            s = self.segments(rows[k])
            owner.append(np.full(len(s), k))
            seg.append(s)
        return np.concatenate(owner), np.concatenate(seg)


def inside(points: np.ndarray, poly: np.ndarray) -> np.ndarray:
    """Which points lie in a polygon; its boundary counts."""
    if len(poly) < 3:
        return np.zeros(len(points), bool)
    a, b = poly, np.roll(poly, -1, axis=0)
    px, py = points[:, :1], points[:, 1:]
    qx, qy = _nearest(px, py, a[:, 0], a[:, 1], b[:, 0], b[:, 1])
    scale = np.maximum(1, np.maximum(np.abs(points).max(axis=1)[:, None], np.maximum(np.abs(a).max(axis=1), np.abs(b).max(axis=1))[None, :]))
    rim = (np.hypot(px - qx, py - qy) <= 10 * EPS * scale).any(axis=1)
    p = np.roll(poly, 1, axis=0)
    over = (a[:, 1] > py) != (p[:, 1] > py)
    rise = np.where(p[:, 1] != a[:, 1], p[:, 1] - a[:, 1], 1)
    odd = (over & (px < (p[:, 0] - a[:, 0]) * (py - a[:, 1]) / rise + a[:, 0])).sum(axis=1) % 2 == 1
    return rim | odd


def _first_least(owner: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((np.arange(len(d)), d, owner))
    keep = np.concatenate(([True], owner[order][1:] != owner[order][:-1])) if len(order) else np.zeros(0, bool)
    out = np.full(n, -1)
    out[owner[order][keep]] = order[keep]
    return out


def _cross(oa, ob, n):
    """Positions (i, j) of all pairs of entries of the same owner, in order of i, then j."""
    sa, sb = np.argsort(oa, kind="stable"), np.argsort(ob, kind="stable")
    nb = np.bincount(ob, minlength=n)
    first = np.concatenate(([0], np.cumsum(nb)))
    times = nb[oa[sa]]
    i = np.repeat(sa, times)
    inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    return i, sb[np.repeat(first[oa[sa]], times) + inner]


def measure(s: Shapes, t: Shapes) -> list[np.ndarray]:
    """d, pax, pay, pbx, pby, contained of each pair."""
    n = len(s.kind)
    out = [np.full(n, np.inf)] + [np.zeros(n) for _ in range(4)]

    def put(rows, got):
        for o, g in zip(out, got):
            o[rows] = g

    both = np.flatnonzero(s.circle & t.circle)
    put(both, rim_rims(s.cx[both], s.cy[both], s.r[both], t.cx[both], t.cy[both], t.r[both]))
    for round_, other, turned in ((s, t, False), (t, s, True)):
        rows = np.flatnonzero(round_.circle & ~other.circle)
        if len(rows):
            owner, seg = other.lines(rows)
            at = rows[owner]
            got = rim_segments(round_.cx[at], round_.cy[at], round_.r[at], *seg.T)
            k = _first_least(owner, got[0], len(rows))
            got = [g[k] for g in got]
            put(rows, [got[0], *got[3:], *got[1:3]] if turned else got)
    rows = np.flatnonzero(~s.circle & ~t.circle)
    if len(rows):
        (oa, sa), (ob, sb) = s.lines(rows), t.lines(rows)
        i, j = _cross(oa, ob, len(rows))
        got = segment_pairs(*sa[i].T, *sb[j].T)
        k = _first_least(oa[i], got[0], len(rows))
        put(rows, [g[k] for g in got])
    contained = np.zeros(n, bool)
    overlap = (s.box[0] <= t.box[2]) & (t.box[0] <= s.box[2]) & (s.box[1] <= t.box[3]) & (t.box[1] <= s.box[3])
    for r in np.flatnonzero((out[0] > 0) & overlap & (s.closed | t.closed)):
        for outer, inner in ((s, t), (t, s)):
            if outer.closed[r]:
                v = inner.vertices(r)
                x0, y0, x1, y1 = (b[r] for b in outer.box)
                v = v[(v[:, 0] >= x0) & (v[:, 0] <= x1) & (v[:, 1] >= y0) & (v[:, 1] <= y1)]
                v = v[inside(v, outer.vertices(r))] if len(v) else v
                if len(v):
                    put(r, [0.0, v[0, 0], v[0, 1], v[0, 0], v[0, 1]])
                    contained[r] = True
                    break
    return [*out, contained]


def overlap_of(a: np.ndarray, b: np.ndarray, tol: float) -> float:
    """Summed collinear overlap of segments a (rows ax, ay, bx, by) and b."""
    a, b = np.repeat(a, len(b), axis=0), np.tile(b, (len(a), 1))
    la, lb = np.hypot(a[:, 2] - a[:, 0], a[:, 3] - a[:, 1]), np.hypot(b[:, 2] - b[:, 0], b[:, 3] - b[:, 1])
    safe = np.where(la > 0, la, 1)
    off = [np.abs(_turn(*a.T, b[:, i], b[:, i + 1])) / safe for i in (0, 2)]
    ux, uy = (a[:, 2] - a[:, 0]) / safe, (a[:, 3] - a[:, 1]) / safe
    s0, s1 = ((b[:, i] - a[:, 0]) * ux + (b[:, i + 1] - a[:, 1]) * uy for i in (0, 2))
    shared = np.maximum(0, np.minimum(la, np.maximum(s0, s1)) - np.maximum(0, np.minimum(s0, s1)))
    return float(shared[(la > 0) & (lb > 0) & (off[0] <= tol) & (off[1] <= tol)].sum())


def segment_stays_inside(seg: np.ndarray, poly: np.ndarray) -> bool:
    """Every piece of the segment between its crossings with the polygon's edges has its middle inside."""
    a, step = seg[:2], seg[2:] - seg[:2]
    l2 = float(step @ step)
    if l2 <= 0:
        return bool(inside(a[None, :], poly)[0])
    c, d = poly, np.roll(poly, -1, axis=0)
    rep = [np.full(len(c), x) for x in seg]
    hit, _ = touches(*rep, c[:, 0], c[:, 1], d[:, 0], d[:, 1])
    den = step[0] * (d[:, 1] - c[:, 1]) - step[1] * (d[:, 0] - c[:, 0])
    cuts = [0.0, 1.0]
    for k in np.flatnonzero(hit):
        if abs(den[k]) < 1e-15:
            ts = [float((q - a) @ step) / l2 for q in (c[k], d[k])]
        else:
            ts = [((c[k, 0] - a[0]) * (d[k, 1] - c[k, 1]) - (c[k, 1] - a[1]) * (d[k, 0] - c[k, 0])) / den[k]]
        cuts += [t for t in ts if 0 < t < 1]
    cuts = np.sort(cuts)
    mid = ((cuts[1:] + cuts[:-1]) / 2)[np.diff(cuts) > 1e-12]
    return bool(inside(a + mid[:, None] * step, poly).all())


def relation(s: Shapes, t: Shapes, r: int) -> str:
    poly, verts, segs = t.vertices(r), s.vertices(r), s.segments(r)
    held = inside(verts, poly)
    if held.all() and all(segment_stays_inside(g, poly) for g in segs):
        return "inside"
    rim = t.segments(r)
    a, b = np.repeat(segs, len(rim), axis=0), np.tile(rim, (len(segs), 1))
    if held.any() or touches(*a.T, *b.T)[0].any() or s.closed[r] and inside(poly[:1], verts)[0]:
        return "partial"
    return "outside"


def beside_origin(s: pa.Array, t: pa.Array) -> tuple[Shapes, Shapes, np.ndarray, np.ndarray]:
    """Both sides with the lower corner of s's box as origin, and that corner: tolerances grow with coordinates, and where a drawing lies
    must not make its entities touch. Whole numbers keep the subtraction exact."""
    a, b = Shapes(s), Shapes(t)
    x, y = (np.nan_to_num(np.floor(c)) for c in a.box[:2])
    a.move(x, y)
    b.move(x, y)
    return a, b, x, y


def distance_udf():
    def run(s: pa.Array, t: pa.Array) -> pa.Array:
        a, b, x, y = beside_origin(s, t)
        d, pax, pay, pbx, pby, contained = measure(a, b)
        got = [d, pax + x, pay + y, pbx + x, pby + y, contained]
        return pa.StructArray.from_arrays([pa.array(g) for g in got], ["d", "pax", "pay", "pbx", "pby", "contained"])

    return F.arrow_udf(run, "d double, pax double, pay double, pbx double, pby double, contained boolean").asNondeterministic()


def overlap_udf():
    def run(s: pa.Array, t: pa.Array, tol: pa.Array) -> pa.Array:
        a, b, _, _ = beside_origin(s, t)
        return pa.array([overlap_of(a.segments(r), b.segments(r), e) for r, e in enumerate(tol.to_pylist())], pa.float64())

    return F.arrow_udf(run, "double").asNondeterministic()


def zone_udf():
    def run(s: pa.Array, t: pa.Array) -> pa.Array:
        a, b, _, _ = beside_origin(s, t)
        near = b.closed & (a.box[0] <= b.box[2]) & (b.box[0] <= a.box[2]) & (a.box[1] <= b.box[3]) & (b.box[1] <= a.box[3])
        return pa.array([relation(a, b, r) if ok else "outside" for r, ok in enumerate(near)], pa.string())

    return F.arrow_udf(run, "string").asNondeterministic()
