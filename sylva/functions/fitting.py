"""Least-squares kernels on arrays of points (n, 3): cylinders, axes, circles. They run inside grouped pandas functions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Reciprocal condition number of the normal equations under which a fit isn't reliable.
RELIABLE = 1e4 * np.finfo(float).eps
ROUNDS = 50
SETTLED = 1e-4


def rotate_to_z(v: np.ndarray) -> np.ndarray:
    """The rotation that takes v to the z axis."""
    v = v / np.linalg.norm(v)
    axis = np.array([v[1], -v[0], 0.0])  # v cross z
    s = np.linalg.norm(axis)
    if s < 1e-12:
        return np.diag([1.0, 1.0, 1.0]) if v[2] > 0 else np.diag([1.0, -1.0, -1.0])
    return rotation(axis / s, np.arctan2(s, v[2]))


def rotation(axis: np.ndarray, radians: float) -> np.ndarray:
    """Turning by an angle about a unit axis."""
    x, y, z = axis
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + np.sin(radians) * k + (1 - np.cos(radians)) * (k @ k)


def tilt(alpha: float, beta: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The turn by alpha about x, then by beta about y, and its derivatives by alpha and by beta."""
    ca, sa, cb, sb = np.cos(alpha), np.sin(alpha), np.cos(beta), np.sin(beta)
    rx, dx = np.array([[1, 0, 0], [0, ca, -sa], [0, sa, ca]]), np.array([[0, 0, 0], [0, -sa, -ca], [0, ca, -sa]])
    ry, dy = np.array([[cb, 0, sb], [0, 1, 0], [-sb, 0, cb]]), np.array([[-sb, 0, cb], [0, 0, 0], [-cb, 0, -sb]])
    return ry @ rx, ry @ dx, dy @ rx


def cylinder_residuals(par: np.ndarray, p: np.ndarray, w: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Signed distances to the cylinder par = (x0, y0, alpha, beta, r) and their derivatives: its axis runs through (x0, y0, 0)
    along the direction that tilt(alpha, beta) takes to z."""
    r, da, db = tilt(par[2], par[3])
    a = r[2]
    q = p - np.array([par[0], par[1], 0.0])
    h = q @ a
    out = q - h[:, None] * a
    d = np.maximum(np.linalg.norm(out, axis=1), 1e-12)
    n = out / d[:, None]
    j = np.stack([-n[:, 0], -n[:, 1], -h * (n @ da[2]), -h * (n @ db[2]), -np.ones(len(p))], 1)
    f = d - par[4]
    return (f, j) if w is None else (f * w, j * w[:, None])


def gauss_newton(residuals, par: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, bool, bool]:
    """(parameters, converged, reliable): undamped steps until the sum of squares settles or the equations degenerate."""
    f, j = residuals(par)
    ss, reliable = f @ f, True
    for _ in range(rounds):
        h = j.T @ j
        scale = np.linalg.norm(h, 1)
        reliable = bool(np.isfinite(scale) and scale > 0 and 1 / np.linalg.cond(h, 1) > RELIABLE)
        if not reliable:
            return par, False, False
        par = par - np.linalg.solve(h, j.T @ f)
        f, j = residuals(par)
        new = f @ f
        if not np.isfinite(new):
            return par, False, False
        if abs(ss - new) < SETTLED * 1e-4:
            return par, True, reliable
        ss = new
    return par, False, reliable


@dataclass
class Cylinder:
    radius: float
    length: float
    start: np.ndarray
    axis: np.ndarray
    mad: float
    coverage: float
    converged: bool
    reliable: bool


def along(p: np.ndarray, axis: np.ndarray, point: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distances to the line, heights along it, vectors from it)."""
    q = p - point
    h = q @ axis
    v = q - h[:, None] * axis
    return np.linalg.norm(v, axis=1), h, v


def basis(axis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two unit vectors that stand on a unit axis and on each other, from the coordinate direction that it holds least of."""
    u = np.cross(axis, np.eye(3)[np.abs(axis).argmin()])
    u /= np.linalg.norm(u)
    return u, np.cross(axis, u)


def surface_coverage(p: np.ndarray, axis: np.ndarray, point: np.ndarray, layers: int, sectors: int, least: float | None = None, length: float | None = None, turns: int = 4) -> float:
    """The share of layer and sector cells that points farther from the axis than `least` hit, for the best of some baselines."""
    d, h, v = along(p, axis, point)
    if least is not None:
        ok = d > least
        h, v = h[ok], v[ok]
    if not len(h):
        return 0.0
    low, size = (h.min(), np.ptp(h)) if length is None else (0.0, length)
    layer = np.clip(np.floor((h - low) / max(size, 1e-12) * layers), 0, layers - 1).astype(int)
    u, w = basis(axis)
    angle = np.arctan2(v @ w, v @ u) % (2 * np.pi)
    width = 2 * np.pi / sectors
    return max(len(np.unique(layer * sectors + np.floor((angle + t * width / turns) / width).astype(int) % sectors)) for t in range(turns)) / (layers * sectors)


def fit_cylinder(p: np.ndarray, axis: np.ndarray, point: np.ndarray, radius: float, weights: np.ndarray | None = None, region: np.ndarray | None = None) -> Cylinder:
    """The cylinder of least weighted squares from a first guess; its ends enclose `region` (or p).

    mad is the mean absolute (weighted) residual; coverage is over cells as high as the points are dense, of points beyond 80 % of the radius.
    """
    turn = rotate_to_z(axis)
    centre = point
    q = (p - centre) @ turn.T
    par, converged, reliable = gauss_newton(lambda x: cylinder_residuals(x, q, weights), np.array([0.0, 0.0, 0.0, 0.0, radius]))
    if not reliable or not np.all(np.isfinite(par)) or par[4] <= 0:
        par, converged = np.array([0.0, 0.0, 0.0, 0.0, radius]), False
    a = turn.T @ tilt(par[2], par[3])[0][2]
    a /= np.linalg.norm(a)
    on = centre + turn.T @ np.array([par[0], par[1], 0.0])
    f, _ = cylinder_residuals(par, q, weights)
    all_ = p if region is None else region
    _, h, _ = along(all_, a, on)
    length, start = float(np.ptp(h)), on + h.min() * a
    layers = int(np.clip(np.ceil(length / max(par[4], 1e-6)), 3, 10))
    sectors = int(np.clip(np.ceil(2 * np.pi * par[4] / 0.04), 8, 36))
    return Cylinder(float(par[4]), length, start, a, float(np.abs(f).mean()), surface_coverage(all_, a, start, layers, sectors, 0.8 * par[4], max(length, 1e-9)), converged, reliable)


def fit_axis(p: np.ndarray, axis: np.ndarray, point: np.ndarray, radius: float, weights: np.ndarray | None = None) -> tuple[np.ndarray, bool]:
    """The direction only of a cylinder of known radius through a known point; steps that make it worse are cut to 5 %."""
    turn = rotate_to_z(axis)
    q = (p - point) @ turn.T
    res = lambda x: cylinder_residuals(np.array([0.0, 0.0, x[0], x[1], radius]), q, weights)
    x = np.zeros(2)
    f, j = res(x)
    for _ in range(ROUNDS):
        j2 = j[:, 2:4]
        h = j2.T @ j2
        if 1 / np.linalg.cond(h, 1) <= RELIABLE:
            return axis / np.linalg.norm(axis), False
        step = np.linalg.solve(h, j2.T @ f)
        fn, jn = res(x - step)
        if fn @ fn > f @ f:
            step = 0.05 * step
            fn, jn = res(x - step)
        done = abs(f @ f - fn @ fn) < 1e-12
        x, f, j = x - step, fn, jn
        if done:
            break
    a = turn.T @ tilt(*x)[0][2]
    return a / np.linalg.norm(a), True


def circle_residuals(par: np.ndarray, p: np.ndarray, w: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Signed distances of (n, 2) points to the circle (x, y, r) and their derivatives."""
    v = p - par[:2]
    d = np.maximum(np.linalg.norm(v, axis=1), 1e-12)
    j = np.column_stack([-v / d[:, None], -np.ones(len(p))])
    f = d - par[2]
    return (f, j) if w is None else (f * w, j * w[:, None])


def fit_circle(p: np.ndarray, centre: np.ndarray, radius: float, weights: np.ndarray | None = None) -> tuple[np.ndarray, float, float, float, bool]:
    """(centre, radius, mad, share of 100 arcs with points, converged)."""
    par, ok, _ = gauss_newton(lambda x: circle_residuals(x, p, weights), np.array([*centre, radius], float), 200)
    f, _ = circle_residuals(par, p, weights)
    v = p - par[:2]
    arcs = len(np.unique(np.floor((np.arctan2(v[:, 1], v[:, 0]) + np.pi) / (2 * np.pi) * 100).clip(0, 99))) / 100
    return par[:2], float(par[2]), float(np.abs(f).mean()), arcs, ok


def fit_circle_centre(p: np.ndarray, centre: np.ndarray, radius: float) -> tuple[np.ndarray, float, bool]:
    """(centre, mad, converged) of a circle of known radius."""
    res = lambda x: tuple(a if a.ndim == 1 else a[:, :2] for a in circle_residuals(np.array([*x, radius]), p))
    par, ok, _ = gauss_newton(res, np.asarray(centre, float), 100)
    return par, float(np.abs(res(par)[0]).mean()), ok


def main_direction(v: np.ndarray) -> np.ndarray:
    """The direction that rows of v are most parallel to, whatever their signs."""
    return np.linalg.eigh(v.T @ v)[1][:, -1]


def dimensions(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, directions, shape ratios) of the box of points (n, 2 or 3) along their main directions, the longest first;
    ratios are those of neighbouring lengths, less than 1."""
    c = p - p.mean(0)
    d = np.linalg.eigh(c.T @ c)[1][:, ::-1].T
    size = np.ptp(c @ d.T, axis=0)
    return size, d, size[1:] / np.maximum(size[:-1], 1e-12)


def first_guess(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(axis, point, radius) from the points' main direction and median distance."""
    c = p.mean(0)
    axis = main_direction(p - c)
    return axis, c, float(np.median(along(p, axis, c)[0]))
