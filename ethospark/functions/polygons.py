"""Polygon expressions (SQL text) and the Arrow helpers for convex hulls.

Polygons in columns are arrays of structs (x, y); their edges arrays of (ax, ay, tx, ty). The numpy
helpers work on whole batches at once: row i of the (n, p) arrays is one animal on one frame.
"""

from __future__ import annotations

import numpy as np

# --- SQL text ------------------------------------------------------------------------------


def edges(points: str) -> str:
    """Closed polygon as an array of edges."""
    following = f"concat(slice({points}, 2, size({points})), slice({points}, 1, 1))"
    return (
        f"zip_with({points}, {following}, (a, b) -> named_struct("
        "'ax', double(a.x), 'ay', double(a.y), 'tx', double(b.x), 'ty', double(b.y)))"
    )


def edge_distance_squared(px: str, py: str) -> str:
    """Squared distance of a point to the edge ``e``."""
    dx, dy = "(e.tx - e.ax)", "(e.ty - e.ay)"
    square = f"({dx} * {dx} + {dy} * {dy})"
    along = f"(({px} - e.ax) * {dx} + ({py} - e.ay) * {dy})"
    t = f"(CASE WHEN {square} > 0 THEN least(greatest({along} / {square}, 0D), 1D) ELSE 0D END)"
    return f"pow({px} - (e.ax + {t} * {dx}), 2D) + pow({py} - (e.ay + {t} * {dy}), 2D)"


def signed_distance(px: str, py: str, polygon_edges: str) -> str:
    """Distance of a point to a polygon's outline: positive inside, negative outside."""
    nearest = f"sqrt(array_min(transform({polygon_edges}, e -> {edge_distance_squared(px, py)})))"
    crossing = (
        f"((e.ay > {py}) != (e.ty > {py})) "
        f"AND {px} < e.ax + ({py} - e.ay) / (e.ty - e.ay) * (e.tx - e.ax)"
    )
    inside = f"size(filter({polygon_edges}, e -> {crossing})) % 2 = 1"
    return (
        f"CASE WHEN {px} IS NULL OR {py} IS NULL THEN NULL WHEN {inside} THEN {nearest} ELSE -{nearest} END"
    )


def polygon_area(points: str) -> str:
    """Area by Green's theorem, positive whichever way the outline runs."""
    return f"abs(aggregate({edges(points)}, 0D, (s, e) -> s + e.ax * e.ty - e.tx * e.ay)) / 2"


def perimeter(points: str) -> str:
    return f"aggregate({edges(points)}, 0D, (s, e) -> s + hypot(e.tx - e.ax, e.ty - e.ay))"


# --- numpy helpers for Arrow batches -------------------------------------------------------


def hulls(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Convex hulls of n point sets given as (n, p) arrays with NaN for missing points.

    Walks around all hulls at once, starting at the leftmost (then lowest) point; every step
    picks, for all rows, the point with nothing to the right of it. Returns (n, h) vertex arrays
    padded by repeating the start, and the vertex counts.
    """
    n, p = x.shape
    row = np.arange(n)
    known = ~(np.isnan(x) | np.isnan(y))
    start = np.lexsort((np.where(known, y, np.inf), np.where(known, x, np.inf)), axis=1)[:, 0]
    sx, sy = x[row, start], y[row, start]
    cx, cy = sx.copy(), sy.copy()
    out_x, out_y = [sx], [sy]
    count = known.any(axis=1).astype(int)
    open_ = count > 0
    for _ in range(p):
        bx, by = cx.copy(), cy.copy()
        for k in range(p):
            dx, dy = x[:, k] - cx, y[:, k] - cy
            ex, ey = bx - cx, by - cy
            turn = ex * dy - ey * dx
            far = dx * dx + dy * dy
            best = ex * ex + ey * ey
            better = known[:, k] & (far > 0) & ((best == 0) | (turn < 0) | ((turn == 0) & (far > best)))
            bx, by = np.where(better, x[:, k], bx), np.where(better, y[:, k], by)
        open_ &= ~((bx == sx) & (by == sy))
        if not open_.any():
            break
        cx, cy = np.where(open_, bx, cx), np.where(open_, by, cy)
        out_x.append(np.where(open_, bx, sx))
        out_y.append(np.where(open_, by, sy))
        count += open_
    return np.stack(out_x, axis=1), np.stack(out_y, axis=1), count


def hull_area_centroid(hx: np.ndarray, hy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Area and centroid of padded hulls; a flat hull's centroid is the middle of its segment."""
    ox, oy = hx[:, :1], hy[:, :1]
    ax, ay = hx - ox, hy - oy
    bx, by = np.roll(ax, -1, axis=1), np.roll(ay, -1, axis=1)
    cross = ax * by - bx * ay
    twice = cross.sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        cx = ((ax + bx) * cross).sum(axis=1) / (3 * twice)
        cy = ((ay + by) * cross).sum(axis=1) / (3 * twice)
    flat = twice == 0
    if flat.any():
        far = np.argmax(ax * ax + ay * ay, axis=1)
        row = np.arange(len(hx))
        cx = np.where(flat, ax[row, far] / 2, cx)
        cy = np.where(flat, ay[row, far] / 2, cy)
    return np.abs(twice) / 2, cx + ox[:, 0], cy + oy[:, 0]


def _segment_distance(px, py, ax, ay, bx, by):
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    along = (px - ax) * dx + (py - ay) * dy
    t = np.clip(np.divide(along, length, out=np.zeros_like(along), where=length > 0), 0.0, 1.0)
    return np.hypot(px - (ax + t * dx), py - (ay + t * dy))


def hull_point_distance(hx, hy, px, py) -> np.ndarray:
    """Distance of one point per row to the row's hull, 0 inside."""
    return hull_distance(hx, hy, px[:, None], py[:, None])


def hull_distance(ax, ay, bx, by) -> np.ndarray:
    """Distance between the two hulls of each row, 0 where they meet.

    Convex shapes are apart iff an edge normal (or, for flat shapes, an edge direction or the
    line between the centres) separates them; then a vertex-to-edge distance is the smallest.
    """
    def against(px, py, qx, qy):
        ex, ey = np.roll(qx, -1, axis=1), np.roll(qy, -1, axis=1)
        d = _segment_distance(
            px[:, :, None], py[:, :, None],
            *(np.broadcast_to(v[:, None, :], (len(px), px.shape[1], v.shape[1])) for v in (qx, qy, ex, ey)),
        )
        return d.min(axis=(1, 2))

    def axes(px, py):
        dx, dy = np.roll(px, -1, axis=1) - px, np.roll(py, -1, axis=1) - py
        return np.concatenate([dx, -dy], axis=1), np.concatenate([dy, dx], axis=1)

    a1, a2 = axes(ax, ay)
    b1, b2 = axes(bx, by)
    mx = (bx.mean(axis=1) - ax.mean(axis=1))[:, None]
    my = (by.mean(axis=1) - ay.mean(axis=1))[:, None]
    ux, uy = np.concatenate([a1, b1, mx], axis=1), np.concatenate([a2, b2, my], axis=1)
    pa = ax[:, :, None] * ux[:, None, :] + ay[:, :, None] * uy[:, None, :]
    pb = bx[:, :, None] * ux[:, None, :] + by[:, :, None] * uy[:, None, :]
    apart = ((pa.max(axis=1) < pb.min(axis=1)) | (pb.max(axis=1) < pa.min(axis=1))).any(axis=1)
    nearest = np.minimum(against(ax, ay, bx, by), against(bx, by, ax, ay))
    return np.where(apart, nearest, 0.0)


def smallest_rectangle(hx: np.ndarray, hy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sides (short, long) of the smallest enclosing rectangle; one side lies on a hull edge.

    Rectangles of equal area (every triangle has three) are decided for the narrowest.
    """
    dx, dy = np.roll(hx, -1, axis=1) - hx, np.roll(hy, -1, axis=1) - hy
    length = np.hypot(dx, dy)
    ok = length > 0
    ux = np.divide(dx, length, out=np.ones_like(dx), where=ok)
    uy = np.divide(dy, length, out=np.zeros_like(dy), where=ok)
    along = hx[:, :, None] * ux[:, None, :] + hy[:, :, None] * uy[:, None, :]
    across = hy[:, :, None] * ux[:, None, :] - hx[:, :, None] * uy[:, None, :]
    w, h = np.ptp(along, axis=1), np.ptp(across, axis=1)
    area = np.where(ok, w * h, np.inf)
    smallest = area <= area.min(axis=1, keepdims=True) * (1 + 1e-9)
    best = np.where(smallest, np.minimum(w, h), np.inf).argmin(axis=1)
    row = np.arange(len(hx))
    a, b = w[row, best], h[row, best]
    return np.minimum(a, b), np.maximum(a, b)
