"""Convex hulls, triangulations and alpha shapes of points of one tree, with numpy only."""

from __future__ import annotations

import numpy as np


def hull_2d(p: np.ndarray) -> np.ndarray:
    """Indices of the hull's corners, counter-clockwise."""
    order = np.lexsort((p[:, 1], p[:, 0]))
    if len(order) < 3:
        return order
    if len(order) > 50:  # what lies well within the polygon of the farthest points of 16 directions is no corner
        turn = np.arange(16) * np.pi / 8
        c = p[(p @ np.stack([np.cos(turn), np.sin(turn)])).argmax(0)]
        e = np.roll(c, -1, 0) - c
        left = (p[:, 1, None] - c[:, 1]) * e[:, 0] - (p[:, 0, None] - c[:, 0]) * e[:, 1]
        order = order[~((left > 1e-9 * np.abs(left).max()) | (e == 0).all(1)).all(1)[order]]

    x, y = p[:, 0].tolist(), p[:, 1].tolist()

    def chain(ids: list[int]) -> list[int]:
        out: list[int] = []
        for i in ids:
            while len(out) > 1:
                a, b = out[-2], out[-1]
                if (x[b] - x[a]) * (y[i] - y[a]) - (y[b] - y[a]) * (x[i] - x[a]) > 0:
                    break
                out.pop()
            out.append(i)
        return out

    order = order.tolist()
    return np.array(chain(order)[:-1] + chain(order[::-1])[:-1])


def polygon_area(c: np.ndarray) -> float:
    x, y = c[:, 0], c[:, 1]
    return float(abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2)


def polygon_centroid(c: np.ndarray) -> np.ndarray:
    """The centre of a polygon's area; of its corners if it has none."""
    x, y = c[:, 0], c[:, 1]
    k = x * np.roll(y, -1) - np.roll(x, -1) * y
    a = k.sum()
    if abs(a) < 1e-15:
        return c.mean(0)
    return np.array([((x + np.roll(x, -1)) * k).sum(), ((y + np.roll(y, -1)) * k).sum()]) / (3 * a)


def spread_diameter(c: np.ndarray) -> float:
    """The largest distance between corners."""
    return float(np.sqrt(((c[:, None] - c[None]) ** 2).sum(-1).max())) if len(c) else 0.0


def is_flat(p: np.ndarray) -> bool:
    """Whether unique rows (n, 3) lie in a plane."""
    if len(p) < 4:
        return True
    i0 = int(p[:, 0].argmin())
    i1 = int(((p - p[i0]) ** 2).sum(1).argmax())
    line = p[i1] - p[i0]
    i2 = int((np.cross(p - p[i0], line) ** 2).sum(1).argmax())
    return bool(np.abs((p - p[i0]) @ np.cross(line, p[i2] - p[i0])).max() < 1e-12)


def hull_3d_volume(p: np.ndarray) -> float:
    """The volume of the convex hull, which the simplices of a triangulation fill; 0 for flat sets."""
    return alpha_sizes([p], [0.0], hull=True)[1][0]


#: Points that are triangulated side by side, if clouds are smaller.
TOGETHER = 50_000


def unique_rows(p: np.ndarray) -> np.ndarray:
    """Different rows in their order, first column first."""
    p = p[np.lexsort(p.T[::-1])] + 0.0
    return p[np.r_[True, (p[1:] != p[:-1]).any(1)]] if len(p) else p


def spheres(pts: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """(centres by axis, squared radii) of the spheres through k + 1 points (m, k) in k dimensions; infinite for flat ones."""
    a, k = pts[0], len(pts) - 1
    v = [[p[:, j] - a[:, j] for j in range(k)] for p in pts[1:]]
    q = [sum(x * x for x in r) for r in v]
    with np.errstate(divide="ignore", invalid="ignore"):
        if k == 2:
            d = 2 * (v[0][0] * v[1][1] - v[0][1] * v[1][0])
            c = [(v[1][1] * q[0] - v[0][1] * q[1]) / d, (v[0][0] * q[1] - v[1][0] * q[0]) / d]
        else:
            cross = lambda x, y: [x[1] * y[2] - x[2] * y[1], x[2] * y[0] - x[0] * y[2], x[0] * y[1] - x[1] * y[0]]
            n = [cross(v[1], v[2]), cross(v[2], v[0]), cross(v[0], v[1])]
            d = 2 * sum(x * y for x, y in zip(v[0], n[0], strict=True))
            c = [(q[0] * n[0][j] + q[1] * n[1][j] + q[2] * n[2][j]) / d for j in range(3)]
    flat = np.abs(d) <= 1e-300
    r2 = sum(x * x for x in c)
    r2[flat] = np.inf
    for j in range(k):
        c[j] = np.where(flat, np.inf, c[j]) + a[:, j]
    return c, r2


def first_corners(p: np.ndarray) -> list[int]:
    """Places of k + 1 points (n, k) that are far from each other, from the line and from the plane through the ones before."""
    i = [int(p[:, 0].argmin())]
    v = p - p[i[0]]
    i.append(int((v * v).sum(1).argmax()))
    for _ in range(p.shape[1] - 1):
        way = v[i[-1]] / max(np.linalg.norm(v[i[-1]]), 1e-300)
        v = v - (v @ way)[:, None] * way
        i.append(int((v * v).sum(1).argmax()))
    return i


def sides(pts: list[np.ndarray], inside: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(n by axis, w) of the lines or planes through k points (m, k): n p + w is below 0 for points p on the other side than `inside`."""
    a, k = pts[0], pts[0].shape[1]
    v = [[p[:, j] - a[:, j] for j in range(k)] for p in pts[1:]]
    if k == 2:
        n = [v[0][1], -v[0][0]]
    else:
        n = [v[0][1] * v[1][2] - v[0][2] * v[1][1], v[0][2] * v[1][0] - v[0][0] * v[1][2], v[0][0] * v[1][1] - v[0][1] * v[1][0]]
    turn = np.where(sum(x * (inside[:, j] - a[:, j]) for j, x in enumerate(n)) < 0, -1.0, 1.0)
    n = [x * turn for x in n]
    return n, -sum(x * a[:, j] for j, x in enumerate(n))


def delaunay_many(clouds: list[np.ndarray], seed: int = 0, sweep: bool = True) -> list[tuple[np.ndarray, np.ndarray]]:
    """(simplices, circumradii) of the Delaunay triangulation of each cloud's unique_rows (n, 2 or 3): a point is added to every
    cloud at once, so a step's calls are shared.

    Points are nudged by a billionth of their extent, so that none lie on a common sphere. They come in order along the longest
    axis, and simplices whose spheres lie behind are looked at no more. Facets of the hull have a simplex with vertex 0, whose
    sphere is all that lies outside; the others fill the hull. A cloud whose simplices don't is done anew in a random order.
    """
    if not clouds:
        return []
    k, count = clouds[0].shape[1], len(clouds)
    n = np.array([len(p) for p in clouds])
    bits = (int(n.max()) + 1).bit_length()
    if count > 1 and k * bits + count.bit_length() > 62:
        return [delaunay_many([p], seed, sweep)[0] for p in clouds]
    none = np.zeros((0, k + 1), int), np.zeros(0)
    first, spans, ids, pts = np.cumsum(n) - n, np.ones(count), [], np.zeros((int(n.sum()), k))
    inside = np.zeros((count, k))
    for t, p in enumerate(clouds):
        if not len(p):
            ids.append(np.zeros(0, int))
            continue
        spans[t] = max(float(np.ptp(p, axis=0).max()), 1e-9)
        q = (p - p.mean(0)) / spans[t] + np.random.default_rng(seed).normal(0, 1e-9, p.shape)
        if sweep:
            q = np.roll(q, -int(np.ptp(q, axis=0).argmax()), axis=1)
        order = np.argsort(q[:, 0], kind="stable") if sweep else np.random.default_rng(seed + 1).permutation(len(p))
        if len(p) > k:
            corner = np.array(first_corners(q))
            order = np.r_[corner, order[~np.isin(order, corner)]]
            inside[t] = q[corner].mean(0)
        ids.append(order)
        pts[first[t] : first[t] + len(p)] = q[order]
    whole = np.flatnonzero(n > k)
    axes = [np.ascontiguousarray(pts[:, j]) for j in range(k)]
    mask = (1 << bits) - 1

    def made(tree: np.ndarray, verts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(factors of a point's square, coordinates and 1 whose sum is below 0 within the sphere; squared radii; ends along the axis)."""
        lift, r2, end = np.zeros((k + 2, len(tree))), np.full(len(tree), np.inf), np.full(len(tree), np.inf)
        at = first[tree][:, None] + verts - 1
        outer = verts[:, 0] == 0
        g, r = np.flatnonzero(outer), np.flatnonzero(~outer)
        side, w = sides([pts[at[g, j]] for j in range(k, 0, -1)], inside[tree[g]])
        for j in range(k):
            lift[1 + j, g] = side[j]
        lift[k + 1, g] = w
        a = pts[at[r, k]]  # from the new point
        c, square = spheres([pts[at[r, j]] for j in range(k, -1, -1)])
        lift[0, r] = 1.0
        for j in range(k):
            lift[1 + j, r] = -2 * c[j]
        with np.errstate(invalid="ignore"):
            lift[k + 1, r] = sum((2 * c[j] - a[:, j]) * a[:, j] for j in range(k))
            r2[r], end[r] = square, np.nan_to_num(c[0] + np.sqrt(square) * (1 + 1e-9) + 1e-9, nan=np.inf)
        return lift, r2, end

    base = np.arange(k + 2)
    verts = np.tile(np.stack([base[base != j] for j in range(k + 2)]), (len(whole), 1)).astype(np.int32)
    tree = np.repeat(whole, k + 2)
    lift, r2, end = made(tree, verts)
    room, used, done, hull = len(tree), len(tree), [], np.zeros(count)

    def fit(size: int) -> None:
        nonlocal room, tree, verts, lift, r2, end
        if size > room:
            more = size + size // 2 - room
            tree, verts, r2, end = np.r_[tree, np.zeros(more, tree.dtype)], np.concatenate([verts, np.zeros((more, k + 1), np.int32)]), np.r_[r2, np.zeros(more)], np.r_[end, np.zeros(more)]
            lift, room = np.concatenate([lift, np.zeros((k + 2, more))], 1), room + more

    def retire(i: int) -> None:
        """Simplices that no point from place i on can lie in leave."""
        nonlocal used
        t = tree[:used]
        over = n[t] <= i
        if sweep:
            over |= end[:used] < axes[0][np.minimum(first[t] + i, len(pts) - 1)]
        gone = np.flatnonzero(over)
        if not len(gone):
            return
        v = verts[gone]
        g = v[:, 0] == 0
        at = first[t[gone[g]]][:, None] + v[g, 1:] - 1
        w = [pts[at[:, j]] - inside[t[gone[g]]] for j in range(k)]
        part = np.abs(w[0][:, 0] * w[1][:, 1] - w[0][:, 1] * w[1][:, 0]) / 2 if k == 2 else np.abs(np.einsum("ij,ij->i", w[0], np.cross(w[1], w[2]))) / 6
        hull[:] += np.bincount(t[gone[g]], part, minlength=count)
        done.append((t[gone[~g]].astype(np.int32), v[~g], r2[gone[~g]].astype(float)))
        stay = np.flatnonzero(~over)
        used = len(stay)
        tree[:used], verts[:used], r2[:used], end[:used] = tree[stay], verts[stay], r2[stay], end[stay]
        for j in range(k + 2):
            lift[j, :used] = lift[j, stay]

    for i in range(k + 1, int(n.max())):
        if i % 8 == 0:
            retire(i)
        p = np.minimum(first + i, len(pts) - 1)
        q = [a[p] for a in axes]
        square = sum(x * x for x in q)
        square[n <= i] = np.nan  # of clouds that are whole
        t = tree[:used]
        power = lift[0, :used] * square[t]
        for j in range(k):
            power += lift[1 + j, :used] * q[j][t]
        power += lift[k + 1, :used]
        slot = np.flatnonzero(power < 0)
        owner, old = t[slot].astype(np.int64), verts[slot].astype(np.int64)
        keys = []
        for out in range(k + 1):
            key = owner
            for j in range(k + 1):
                if j != out:
                    key = (key << bits) | old[:, j]
            keys.append(key)
        key = np.sort(np.concatenate(keys))
        same = np.r_[False, key[1:] == key[:-1], False]
        key = key[~(same[1:] | same[:-1])]
        new = np.empty((len(key), k + 1), np.int32)
        new[:, k] = i + 1
        for j in range(k - 1, -1, -1):
            new[:, j] = key & mask
            key = key >> bits
        at = slot[: len(key)]
        if len(key) < len(slot):  # the last ones take the places that are left
            free = slot[len(key) :]
            left = used - len(free)
            move = np.setdiff1d(np.arange(left, used), free)
            to = free[free < left]
            tree[to], verts[to], r2[to], end[to], lift[:, to] = tree[move], verts[move], r2[move], end[move], lift[:, move]
            back = np.searchsorted(move, at)
            moved = (back < len(move)) & (move[np.minimum(back, max(len(move) - 1, 0))] == at) if len(move) else np.zeros(len(at), bool)
            at = np.where(moved, to[np.minimum(back, max(len(to) - 1, 0))], at) if len(move) else at
            used = left
        elif len(key) > len(slot):
            fit(used + len(key) - len(slot))
            at = np.r_[at, np.arange(used, used + len(key) - len(slot))]
            used += len(key) - len(slot)
        lift[:, at], r2[at], end[at] = made(key, new)
        tree[at], verts[at] = key, new
    retire(int(n.max()))
    t, v, r = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int32), np.zeros((0, k + 1), np.int32), np.zeros(0))
    order = np.argsort(t, kind="stable")
    ends = np.searchsorted(t[order], np.arange(count + 1))
    out: list = [none] * count
    for c in whole.tolist():
        mine = order[ends[c] : ends[c + 1]]
        s = v[mine]
        full = sizes(pts[first[c] : first[c] + n[c]], s - 1).sum()
        out[c] = ids[c][s - 1], np.sqrt(r[mine]) * spans[c]
        if sweep and not abs(full - hull[c]) <= 1e-9 + 1e-6 * hull[c]:
            out[c] = delaunay_many([clouds[c]], seed, False)[0]
    return out


def delaunay(p: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(simplices, circumradii) of the Delaunay triangulation of the unique_rows of points (n, 2 or 3)."""
    return delaunay_many([unique_rows(p)], seed)[0]


def sizes(p: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Areas or volumes of simplices of unique rows."""
    if not len(s):
        return np.zeros(0)
    v = [p[s[:, j]] - p[s[:, 0]] for j in range(1, s.shape[1])]
    if len(v) == 2:
        return np.abs(v[0][:, 0] * v[1][:, 1] - v[0][:, 1] * v[1][:, 0]) / 2
    return np.abs(np.einsum("ij,ij->i", v[0], np.cross(v[1], v[2]))) / 6


def filled(s: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """keep, and the simplices left out that no way through others left out leads from to the outside."""
    k = s.shape[1] - 1
    if keep.all() or not len(s):
        return keep
    s, top = np.sort(s, axis=1), int(s.max()) + 1
    codes = []
    for j in range(k + 1):
        f = np.delete(s, j, axis=1)
        codes.append(((f[:, 0] * top + f[:, 1]) * top + f[:, 2]) if k == 3 else f[:, 0] * top + f[:, 1])
    code, bits = np.concatenate(codes), len(s).bit_length()
    if k * top.bit_length() + bits <= 62:  # one number of both is sorted faster
        code = np.sort((code << bits) | (np.arange(len(code)) % len(s)))
        owner, code = code & ((1 << bits) - 1), code >> bits
    else:
        order = np.argsort(code, kind="stable")
        owner, code = order % len(s), code[order]
    same = np.r_[False, code[1:] == code[:-1], False]
    rim = np.zeros(len(s), bool)
    rim[owner[~(same[1:] | same[:-1])]] = True
    out = rim & ~keep
    first = np.flatnonzero(same[1:-1])
    a, b = owner[first], owner[first + 1]
    free = ~keep[a] & ~keep[b]
    a, b = a[free], b[free]
    while True:
        more = np.concatenate([b[out[a] & ~out[b]], a[out[b] & ~out[a]]])
        if not len(more):
            return ~out
        out[more] = True


def alpha_sizes(clouds: list[np.ndarray], alphas: list[float], fill: bool = False, hull: bool = False) -> list[float] | tuple[list[float], list[float]]:
    """Area (2-D) or volume (3-D) of the alpha shape of each cloud: the Delaunay simplices whose circumradius is below its alpha;
    with `fill`, also the holes that they enclose. Clouds are triangulated side by side. With `hull`, also the volumes of their
    convex hulls, 0 for flat clouds."""
    p = [unique_rows(x) for x in clouds]
    out, whole, turn = [0.0] * len(p), [0.0] * len(p), sorted(range(len(p)), key=lambda i: -len(p[i]))
    while turn:
        own = turn[: max(1, TOGETHER // max(1, len(p[turn[0]])))]
        turn = turn[len(own) :]
        for i, (s, r) in zip(own, delaunay_many([p[i] for i in own]), strict=True):
            keep, part = r < alphas[i], sizes(p[i], s)
            out[i] = float(part[filled(s, keep) if fill else keep].sum())
            whole[i] = float(part.sum()) if hull and not is_flat(p[i]) else 0.0
    return (out, whole) if hull else out


def alpha_size(p: np.ndarray, alpha: float, fill: bool = False) -> float:
    """alpha_sizes of one cloud."""
    return alpha_sizes([p], [alpha], fill)[0]
