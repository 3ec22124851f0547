"""Kernels that fit cylinders to segments and surfaces to stems."""

from __future__ import annotations

from dataclasses import replace

import numpy as np

from .fitting import Cylinder, along, first_guess, fit_cylinder, fit_circle_centre

MOST_CANDIDATES = 11


def fit_segment(p: np.ndarray, layer: np.ndarray, least: int = 20) -> list[Cylinder]:
    """Cylinders along a segment of points (n, 3) in layers 0, 1, ...

    From the layer reached so far, regions of 3 to 11 layers are fitted, points far from the first guess weighted less; the fit
    with the highest coverage less 1 % of length over radius is taken and the next begins where it ends. Up to six layers
    are one region.
    """
    last, at, out = int(layer.max(initial=-1)), 0, []
    while at <= last:
        sizes = [last - at + 1] if last < 6 else [n for n in range(3, MOST_CANDIDATES + 1) if at + n <= last + 1] or [last - at + 1]
        best = None
        for n in sizes:
            ok = (layer >= at) & (layer < at + n)
            q = p[ok]
            if len(q) < least:
                continue
            axis, point, radius = first_guess(q) if not out else (out[-1].axis, q.mean(0), out[-1].radius)
            if not out and n > 1:  # along the layers
                way = p[ok & (layer >= at + n - max(1, n // 3))].mean(0) - p[ok & (layer < at + max(1, n // 3))].mean(0)
                if np.linalg.norm(way) > 1e-9:
                    axis = way / np.linalg.norm(way)
                    radius = float(np.median(along(q, axis, point)[0]))
            if radius <= 0:
                continue
            d = along(q, axis, point)[0]
            w = 1 / (1 + (np.abs(d - radius) / max(0.1 * radius, 1e-6)) ** 2) ** 0.5
            f = fit_cylinder(q, axis, point, radius, w)
            up = p[ok & (layer >= at + n - 1)].mean(0) - p[ok & (layer == at)].mean(0) if n > 1 else f.axis
            if f.axis @ up < 0:
                f.start, f.axis = f.start + f.length * f.axis, -f.axis
            good = f.converged and f.reliable and f.radius < 2 * radius + 0.01 and f.mad < 0.5 * f.radius + 0.005
            score = f.coverage - 0.01 * f.length / max(f.radius, 1e-6)
            if best is None or (good, score) > best[:2]:
                best = (good, score, n, f)
        if best is None:
            break
        _, _, n, f = best
        if not best[0]:
            q = p[(layer >= at) & (layer < at + n)]
            d = along(q, f.axis, f.start)[0]
            f.radius = min(f.radius, float(np.median(d)) if len(d) else f.radius)
        out.append(f)
        at += n
    return out


def segment_cylinders(p: np.ndarray, layer: np.ndarray, sets: np.ndarray, least: int = 20) -> list[tuple[int, Cylinder]]:
    """The cylinders of a segment, if it has over one layer (from 1), two sets and `least` points, with their places."""
    if len(p) <= least or len(np.unique(layer)) < 2 or len(np.unique(sets)) <= 2:
        return []
    return [(k, f) for k, f in enumerate(fit_segment(p, layer - 1)) if f.length > 0]


def crossing(start: np.ndarray, axis: np.ndarray, c: Cylinder) -> float | None:
    """How far along a line from start its last crossing with the surface of c, taken as endless, is: ahead of a start inside c, behind
    one that points away from it. None if the line misses it."""
    a = axis - (axis @ c.axis) * c.axis
    b = (start - c.start) - ((start - c.start) @ c.axis) * c.axis
    e, f, g = a @ a, 2 * (a @ b), b @ b - c.radius**2
    root = f * f - 4 * e * g
    return float((-f + np.sqrt(root)) / (2 * e)) if root >= 0 and e > 1e-12 else None


def between_lines(p: np.ndarray, d: np.ndarray, c: Cylinder) -> tuple[float, float]:
    """(distance of a line and the axis line of c, the place on c's axis, from its start)."""
    w, n = p - c.start, np.cross(d, c.axis)
    size = n @ n
    if size < 1e-12:
        h = float(w @ c.axis)
        return float(np.linalg.norm(w - h * c.axis)), h
    return float(abs(w @ n) / np.sqrt(size)), float(np.cross(d, w) @ n / size)


def hang(own: list[Cylinder], parents: list[Cylinder], childless: bool = False) -> tuple[int | None, list[Cylinder], bool]:
    """(parent cylinder of a branch as an index, the branch's cylinders as they then are, whether one was put before them).

    Of the parent segment's cylinders the four of nearest starts are tried. The first whose surface the first cylinder's axis
    crosses, ahead or behind, within its ends is the parent, and the first cylinder begins there. Else the one that is missed
    by least at its ends: by under a tenth of its length, the same holds; if it is near, the first cylinder is dropped and the
    second begins there; if it isn't, the first one is only dropped. A lone cylinder of a branch without children is
    dropped and the branch with it; of one with children it is cut to what leads to a near crossing. Where no parent was
    found, it is the one whose axis passes nearest within its ends (20 % beyond them, if none does), else the one from whose
    start the way leads most along the branch; a cylinder over the gap is put before the others if it is over 1 cm and a
    fifth of the first one long.
    """
    if not parents:
        return None, own, False
    if len(parents) == 1:
        return 0, own, False
    order = np.argsort([((c.start - own[0].start) ** 2).sum() for c in parents], kind="stable")[:4].tolist()
    own, first = list(own), own[0]

    def begin(x: float) -> None:
        own[0] = replace(first, start=first.start + x * first.axis, length=first.length - x)

    missed = []
    for k in order:
        c = parents[k]
        x = crossing(first.start, first.axis, c)
        if x is None:
            continue
        h = float((first.start + x * first.axis - c.start) @ c.axis)
        over = -h if h < 0 else max(0.0, h - c.length)
        if x < first.length and over == 0:
            begin(x)
            return k, own, False
        missed.append((over if x < first.length else abs(h), k, x, x < first.length))
    if missed:
        over, k, x, fits = min(missed, key=lambda m: m[0])
        c = parents[k]
        if fits and over < 0.1 * c.length:
            begin(x)
            return k, own, False
        near = x <= first.radius
        if len(own) > 1:
            place = first.start + x * first.axis
            own = own[1:]
            if near and over <= 1.25 * c.length:
                way = own[0].start + own[0].length * own[0].axis - place
                n = float(np.linalg.norm(way))
                if n > 1e-9:
                    own[0] = replace(own[0], start=place, axis=way / n, length=n)
                return k, own, False
        elif childless:
            return None, [], False
        elif near and over <= 1.5 * c.length and abs(x) > 1e-9:
            own[0] = replace(first, start=first.start + x * first.axis, length=abs(x))
            return k, own, False
    first = own[0]
    lines = [(*between_lines(first.start, first.axis, parents[k]), k) for k in order]
    on = [m for m in lines if 0 <= m[1] <= parents[m[2]].length] or [m for m in lines if -0.2 * parents[m[2]].length <= m[1] <= 1.2 * parents[m[2]].length]
    if on:
        _, h, k = min(on, key=lambda m: m[0])
        foot = parents[k].start + h * parents[k].axis
    else:
        along_it = lambda k: float((first.start - parents[k].start) @ first.axis) / max(float(np.linalg.norm(first.start - parents[k].start)), 1e-12)
        k = max(order, key=along_it)
        foot = parents[k].start
    c, way = parents[k], first.start - foot
    size = float(np.linalg.norm(way))
    if size > 1e-9:
        way = way / size
        out = float(np.sqrt(max(0.0, 1 - (way @ c.axis) ** 2))) * size  # from the parent's axis
        if out > c.radius:
            gap = (out - c.radius) / out * size
            if gap > 0.01 and gap > 0.2 * first.length:
                own.insert(0, replace(first, start=foot + c.radius / out * size * way, axis=way, length=gap))
                return k, own, True
    return k, own, False


def hang_all(tree: int, fits: list[tuple[int, int, list[tuple[int, Cylinder]]]]) -> list[tuple]:
    """CYLINDER rows (plans.reconstruct) of a tree's segments (number, the parent's or 0, cylinders) in the order of their numbers:
    segments as branches, each hung on a cylinder of its parent's. One without cylinders passes its children on to its parent."""
    rows, at, branch_of, order, cyls = [], 1, {}, {}, {}
    up = {seg: parent for seg, parent, _ in fits}
    parents_of = {*up.values()}
    for seg, _, own in fits:
        own = [c for _, c in own]
        over = up[seg]
        while over and over not in cyls:
            over = up.get(over, 0)
        parent, extra = None, False
        if over:
            k, own, extra = hang(own, [c for _, c in cyls[over]], seg not in parents_of)
            if not own:
                continue
            parent = cyls[over][k]
        branch_of[seg], order[seg] = len(branch_of) + 1, order[over] + 1 if over else 0
        cyls[seg] = []
        for k, c in enumerate(own):
            on = (at - 1 if k else (parent[0] if parent else None), at + 1 if k + 1 < len(own) else None)
            rows.append((tree, branch_of[seg], k + 1, at, c.radius, c.length, *c.start, *c.axis, *on, bool(extra and k == 0), order[seg], c.coverage, c.mad))
            cyls[seg].append((at, c))
            at += 1
    return rows


def recentre(p: np.ndarray, c: Cylinder, before: float) -> None:
    """A cylinder whose radius was changed by over 5 mm is moved across its axis to where its points fit the new radius best."""
    if abs(c.radius - before) <= 0.005 or len(p) < 8:
        return
    from .fitting import basis

    u, v = basis(c.axis)
    _, _, out = along(p, c.axis, c.start)
    centre, _, ok = fit_circle_centre(np.column_stack([out @ u, out @ v]), np.zeros(2), c.radius)
    if ok and np.linalg.norm(centre) < c.radius:
        c.start = c.start + centre[0] * u + centre[1] * v


# --- surfaces of stems -----------------------------------------------------------------------------------------------


def resample(curve: np.ndarray, spacing: float) -> np.ndarray:
    """A closed curve as points at equal distances, as near to the spacing as a whole number of them allows, six at least."""
    closed = np.vstack([curve, curve[:1]])
    s = np.concatenate([[0.0], np.cumsum(np.linalg.norm(np.diff(closed, axis=0), axis=1))])
    n = max(6, int(round(s[-1] / spacing)))
    t = np.linspace(0, s[-1], n, endpoint=False)
    return np.column_stack([np.interp(t, s, closed[:, k]) for k in range(curve.shape[1])])


def first_curve(p: np.ndarray, spacing: float, window: float = 15.0, step: float = 20.0) -> np.ndarray | None:
    """A boundary curve of a slice of points (n, 2): the nearest point to the middle in windows of 15 degrees every 20, smoothed
    and resampled; None where under half of the windows have points."""
    middle = p.mean(0)
    v = p - middle
    d, angle = np.linalg.norm(v, axis=1), np.degrees(np.arctan2(v[:, 1], v[:, 0])) % 360
    radii, at = [], np.arange(0, 360, step)
    for a in at:
        off = np.abs((angle - a + 180) % 360 - 180) <= window / 2
        radii.append(d[off].min() if off.any() else np.nan)
    radii = np.array(radii)
    ok = ~np.isnan(radii)
    if ok.sum() * 2 < len(at):
        return None
    radii = np.interp(at, at[ok], radii[ok], period=360)
    radii = np.median(np.stack([np.roll(radii, -1), radii, np.roll(radii, 1)]), axis=0)
    t = np.radians(at)
    return resample(middle + radii[:, None] * np.column_stack([np.cos(t), np.sin(t)]), spacing)


def next_curve(p: np.ndarray, seed: np.ndarray, ball: float, longest: float, smooth: bool = False) -> np.ndarray:
    """The boundary of the next slice from the one above: each seed point moves to the mean of the points nearest to it within
    `ball`; seeds without points move as their neighbours do; long elements are divided and short ones merged. With `smooth`,
    points go to the mean of themselves and both neighbours."""
    d = ((p[:, None] - seed[None]) ** 2).sum(-1)
    own, near = d.argmin(1), d.min(1) < ball * ball
    moves = np.full(seed.shape, np.nan)
    for i in np.unique(own[near]):
        moves[i] = p[near & (own == i)].mean(0) - seed[i]
    ok = ~np.isnan(moves[:, 0])
    if not ok.any():
        return seed
    at = np.arange(len(seed))
    moves = np.column_stack([np.interp(at, at[ok], moves[ok, k], period=len(seed)) for k in range(2)])
    curve = seed + moves
    if smooth:
        curve = (np.roll(curve, 1, 0) + curve + np.roll(curve, -1, 0)) / 3
    return resample(curve, longest)


def crosses_itself(c: np.ndarray) -> bool:
    """Whether two elements of a closed curve that aren't neighbours cross."""
    n = len(c)
    d = np.roll(c, -1, 0) - c
    w = c[None] - c[:, None]
    det = d[:, None, 0] * d[None, :, 1] - d[:, None, 1] * d[None, :, 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        s = (w[..., 0] * d[None, :, 1] - w[..., 1] * d[None, :, 0]) / det
        t = (w[..., 0] * d[:, None, 1] - w[..., 1] * d[:, None, 0]) / det
    i, j = np.triu_indices(n, 2)
    far = ~((i == 0) & (j == n - 1))
    i, j = i[far], j[far]
    return bool(((s[i, j] > 0) & (s[i, j] < 1) & (t[i, j] > 0) & (t[i, j] < 1)).any())


def stem_surface(p: np.ndarray, height: float, width: float) -> tuple[np.ndarray, np.ndarray, float] | None:
    """(vertices (n, 3), facets (m, 3), the height that it begins at) of a closed mesh round the points of a stem; None if
    there is no curve to begin with or the volume isn't positive.

    Slices are taken from the top down, each boundary seeded by the one above; where a curve crosses itself the one above is
    carried on, for 0.75 m at most. All curves are resampled to as many points as the first, whose places by angle they share,
    so neighbouring rings are joined by two triangles an element; fans close both ends.
    """
    top, low = p[:, 2].max(), p[:, 2].min()
    rings, z = [], top - height / 2
    bad = 0.0
    while z - height / 2 >= low - 1e-9:
        q = p[np.abs(p[:, 2] - z) <= height / 2][:, :2]
        c = None
        if len(q) >= 10:
            c = first_curve(q, width) if not rings else next_curve(q, rings[-1][0], max(2 * width, 0.05), width)
            if c is not None and crosses_itself(c):
                c = None
        if c is None:
            bad += height
            if rings and bad <= 0.75:
                c = rings[-1][0]
            elif rings:
                break
        else:
            bad = 0.0
        if c is not None:
            rings.append((c, z))
        z -= height
    if len(rings) < 2:
        return None
    n = max(8, len(rings[0][0]))
    t = np.linspace(-np.pi, np.pi, n, endpoint=False)
    vertices = []
    for c, z in rings:
        m = c.mean(0)
        v = c - m
        a, r = np.arctan2(v[:, 1], v[:, 0]), np.linalg.norm(v, axis=1)
        o = np.argsort(a)
        r = np.interp(t, a[o], r[o], period=2 * np.pi)
        vertices.append(np.column_stack([m[0] + r * np.cos(t), m[1] + r * np.sin(t), np.full(n, z)]))
    v = np.concatenate(vertices)
    k, j = np.meshgrid(np.arange(len(rings) - 1), np.arange(n), indexing="ij")
    a, b = (k * n + j).ravel(), (k * n + (j + 1) % n).ravel()
    side = np.concatenate([np.column_stack([a, a + n, b]), np.column_stack([b, a + n, b + n])])
    j = np.arange(n)
    caps = [np.column_stack([np.full(n, len(v)), j, (j + 1) % n]), np.column_stack([np.full(n, len(v) + 1), (len(rings) - 1) * n + (j + 1) % n, (len(rings) - 1) * n + j])]
    v = np.vstack([v, vertices[0].mean(0), vertices[-1].mean(0)])
    facets = np.concatenate([side, *caps])
    return (v, facets, float(rings[-1][1])) if volume(v, facets) > 0 else None


def volume(v: np.ndarray, facets: np.ndarray) -> float:
    """The enclosed volume in litres, positive if the facets face outwards."""
    a, b, c = (v[facets[:, k]] for k in range(3))
    return float(1000 * np.einsum("ij,ij->i", a, np.cross(b, c)).sum() / 6)


def surface(v: np.ndarray, facets: np.ndarray) -> np.ndarray:
    """The area of each facet."""
    a, b, c = (v[facets[:, k]] for k in range(3))
    return np.linalg.norm(np.cross(b - a, c - a), axis=1) / 2
