"""Models of trees that a task can hold, in arrays: what reconstruct's tables do step by step, where a tree's points lie.

Points move once, whatever the number of models, and only cylinders leave the task.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np

from ..functions import forest, stems
from ..functions import neighbours as near_by
from ..operators.kernels import recentred_starts
from ..sources.params import Params


def visits(ids: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The halves of cover.order_of's md5 of each point, as numbers that sort like its text."""
    h = np.frombuffer(b"".join(md5(f"{seed}:{i}".encode()).digest() for i in ids.tolist()), ">u8").reshape(-1, 2)
    return h[:, 0], h[:, 1]


def ranked(ids: np.ndarray, visit: tuple[np.ndarray, np.ndarray], size_class: np.ndarray | None = None) -> np.ndarray:
    order = np.lexsort((ids, visit[1], visit[0], *(() if size_class is None else (size_class,))))
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


def base_sets(c: np.ndarray) -> np.ndarray:
    """treesets.base_sets of the sets of one tree."""
    low, wide = c[:, 2].min(), np.ptp(c[:, :2], axis=0).max()
    limit = min(1.5, 0.02 * (c[:, 2].max() - low))
    for step in range(6):
        on = (c[:, 2] < low + limit - 0.05 * step) | (c[:, 2] == low)
        if np.ptp(c[on, :2], axis=0).max() <= 0.3 * wide:
            break
    return np.flatnonzero(on)


def relative_sizes(rows: np.ndarray, up: np.ndarray, nei: list[np.ndarray], z: np.ndarray) -> np.ndarray:
    """cover.relative_size of each set, NaN for those of no segment. rows: (segment from 0, layer from 1, set)."""
    seg, layer, at = rows.T
    count, deep = len(up), int(layer.max())
    n = np.bincount(seg * (deep + 1) + layer, minlength=count * (deep + 1)).reshape(count, deep + 1)
    last = np.array([np.flatnonzero(x).max() for x in n])
    wide = np.array([x[2:7][x[2:7] > 0].mean() if x[2:7].any() else float(x[1]) for x in n])
    low, h = z.min(), np.ptp(z)
    base = np.full(count, np.inf)
    np.minimum.at(base, seg[layer == 1], z[at[layer == 1]])
    raw = wide / wide[0] * 256
    raw = np.where(last >= 2, np.ceil(raw), raw)
    most = np.ceil(256 * ((h - (base - low)) / h)) if h else np.full(count, 256.0)
    size = np.minimum(raw, most)
    size[0] = 256.0
    rs = size[seg] - (size[seg] - 1) * np.sqrt((layer - 1) / last[seg])
    half = np.zeros(len(z), bool)
    for s in np.flatnonzero(up >= 0):
        first, second = at[(seg == s) & (layer == 1)], at[(seg == s) & (layer == 2)]
        half[first] = True
        around = np.unique(np.concatenate([nei[i] for i in first]))
        half[np.setdiff1d(around, second)] = True
    rs = np.minimum(255, np.floor(np.where(half[at], np.floor(rs + 0.5) / 2, rs) + 0.5))
    out = np.full(len(z), -np.inf)
    np.maximum.at(out, at, rs)
    return np.where(np.isfinite(out), np.maximum(out, 1), np.nan)


def listed(found: list) -> np.ndarray:
    """(segment from 0, layer from 1, set) rows of segments."""
    rows = [(np.full(len(x), s), np.full(len(x), k + 1), x) for s, (layers, _, _) in enumerate(found) for k, x in enumerate(layers)]
    return np.stack([np.concatenate(x) for x in zip(*rows, strict=True)], 1).astype(np.int64)


def least_of(n: int, at: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The least value at each of n places, -1 where there is none."""
    out = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(out, at, value)
    return np.where(out == np.iinfo(np.int64).max, -1, out)


def main_segments(up: np.ndarray, orders: int = 3) -> np.ndarray:
    """treesets.main_segments as a mask."""
    out = np.zeros(len(up), bool)
    level = np.array([0])
    for _ in range(orders + 1):
        out[level] = True
        level = np.flatnonzero(np.isin(up, level))
    return out


def limited(c: dict[str, np.ndarray], own: slice, parent_correction: bool, smallest: float) -> tuple[np.ndarray, float, float]:
    """(radii, max_r, min_r) of a branch, as cylinders.limit_radii."""
    r, sc, on = c["radius"][own], c["surf_cov"][own], int(c["parent"][own][0])
    least, r7, r4 = r.min(), r[sc > 0.7], r[sc > 0.4]
    max_r = max(0.95 * c["radius"][on], smallest) if on >= 0 else 1.25 * r[:3].max()
    min_r = r7.min() if len(r7) and least >= r7.min() / 2 else r4.min() if len(r4) else smallest
    low, poor, short = np.maximum(r, min_r), sc < 0.7, len(r) <= 3
    if parent_correction or short:
        low = np.where(((low > max_r) & poor) | (low > 1.2 * max_r), max_r, low)
    if short:
        low = np.where(poor & (low > 0.75 * max_r), np.maximum(sc / 0.7 * low, min_r), low)
    return low, max_r, min_r


def smoothed(r: np.ndarray, sc: np.ndarray) -> np.ndarray:
    """cylinders.smooth_radii of a branch."""
    out = r.copy()
    k = 1 + np.flatnonzero((sc[1:-1] < 0.7) & (sc[:-2] >= 0.7) & (sc[2:] >= 0.7))
    out[k] = (r[k - 1] + r[k + 1]) / 2
    return out


def tapered(r: np.ndarray, sc: np.ndarray, length: np.ndarray, max_r: float, min_r: float) -> np.ndarray:
    """cylinders.taper_correction of a branch."""
    n, poor = len(r), sc < 0.7
    rmin, rmax = r.min(), r.max()
    step = np.arange(n) / (n - 1) if n > 1 else np.zeros(n)
    if rmax < 0.001:
        if n == 1:
            return r
        middle = 2 * (r.sum() - rmin - rmax) / (n - 2) if n > 2 else 0.0
        top = rmax if n == 2 else min(0.01, rmax) if middle > rmax else middle
        end = min(0.5 * rmin, 0.001) if n > 2 else 0.5 * rmax
        return top + (end - top) * step
    if n > 4:
        run = np.cumsum(length)
        at = run - length / 2
        l2, t2, y = at * at, run[-1] * run[-1], sc * 1.05 * r
        s4, s2, s0 = (sc * l2 * l2).sum() + t2 * t2, (sc * l2).sum() + t2, sc.sum() + 1
        y2, y0 = (y * l2).sum() + min_r * t2, y.sum() + min_r
        det = s4 * s0 - s2 * s2
        up = np.full(n, min_r)
        if det:
            up = np.maximum(min((y2 * s0 - y0 * s2) / det, -1e-4) * at * at + (s4 * y0 - s2 * y2) / det, min_r)
        if up.max() > max_r:
            up = max_r / up.max() * up
        down = np.maximum(0.75 * up, min_r)
        out = np.where((r > up) & poor, up + (r - up) * sc / 0.7, np.where((r > 1.333 * up) & ~poor, up + (r - up) * sc, r))
        return np.where(((out < down) & poor) | (out < 0.5 * down), down, out)
    good = r[~poor]
    first = good.max() if len(good) else (r * sc).sum() / sc.sum() if sc.sum() else rmax
    last = good.min() if len(good) > 1 else rmin
    line = first + (last - first) * step
    return np.where(poor, line + (r - line) * sc / 0.7, r)


def adjusted(xyz: np.ndarray, rows: list[tuple], params: Params) -> list[tuple]:
    """reconstruct.adjust of one tree's CYLINDER rows, whose cyl_id counts from 1."""
    names = ("tree_id", "branch", "position", "cyl_id", "radius", "length", "start_x", "start_y", "start_z", "axis_x", "axis_y", "axis_z", "parent", "extension", "added", "branch_order", "surf_cov", "mad")
    c = dict(zip(names, zip(*rows, strict=True), strict=True))
    a = {n: np.array(c[n], float) for n in ("radius", "length", "surf_cov")} | {"parent": np.array([p - 1 if p is not None else -1 for p in c["parent"]])}
    start, axis = (np.column_stack([c[f"{n}_{x}"] for x in "xyz"]).astype(float) for n in ("start", "axis"))
    branch = np.array(c["branch"])
    ends = np.r_[np.flatnonzero(np.r_[True, branch[1:] != branch[:-1]]), len(branch)]
    radius = a["radius"].copy()
    for lo, hi in zip(ends[:-1], ends[1:], strict=True):
        own = slice(lo, hi)
        r, max_r, min_r = limited(a, own, params.parent_cor, params.min_cyl_rad)
        r = smoothed(r, a["surf_cov"][own])
        radius[own] = tapered(r, a["surf_cov"][own], a["length"][own], max_r, min_r) if params.taper_cor else r
    length = a["length"]
    start = recentred_starts(xyz, start, axis, radius, a["radius"], length)
    # starts in the plane through the end before
    end, shift = start + axis * length[:, None], np.zeros(len(branch))
    k = np.flatnonzero(branch[1:] == branch[:-1]) + 1
    down = (axis[k] * axis[k - 1]).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        by = np.where(down != 0, ((end[k - 1] - start[k]) * axis[k - 1]).sum(1) / down, 0.0)
    shift[k] = np.where(np.abs(by) <= 0.5 * length[k], by, 0.0)
    start, length = start + axis * shift[:, None], length - shift
    # first cylinders on their parents' surfaces
    old_start, old_axis, old_length = start.copy(), axis.copy(), length.copy()
    for k in ends[:-1]:
        on = a["parent"][k]
        if on < 0:
            continue
        h = max(0.0, min(old_length[on], (old_start[k] - old_start[on]) @ old_axis[on]))
        foot = old_start[on] + h * old_axis[on]
        out = old_start[k] - foot
        d = np.linalg.norm(out)
        if d - radius[on] > 0.001:
            start[k] = foot + out * (radius[on] / d)
            way = old_start[k] + old_axis[k] * old_length[k] - start[k]
            length[k] = np.linalg.norm(way)
            axis[k] = way / length[k] if length[k] else np.nan
    return [(*r[:4], radius[i], length[i], *start[i], *axis[i], *r[12:]) for i, r in enumerate(rows)]


class Trees:
    """Points of whole trees, in order of trees (codes) and ids."""

    def __init__(self, tree: np.ndarray, ids: np.ndarray, xyz: np.ndarray):
        self.tree, self.ids, self.xyz = tree, ids, xyz
        self.at = np.searchsorted(tree, np.arange(int(tree[-1]) + 2))

    def cover(self, rank: np.ndarray, reach: np.ndarray, ball: np.ndarray, nmin: int, among: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
        """(places of sets, each point's set or -1, neighbours) by tree, sets and points counted within it; trees among those of a mask."""
        own = np.flatnonzero(among[self.tree])
        codes, code = np.unique(self.tree[own], return_inverse=True)
        centre, member, src, dst = near_by.cover(code, self.xyz[own], rank[own], reach[own], ball[own], nmin)
        first, begins = np.searchsorted(code[centre], np.arange(len(codes) + 1)), np.searchsorted(code, np.arange(len(codes) + 1))
        link = np.searchsorted(src, first)
        out: list = [None] * (len(self.at) - 1)
        for i, t in enumerate(codes.tolist()):
            m = member[begins[i] : begins[i + 1]]
            links = slice(link[i], link[i + 1])
            nei = forest.neighbour_lists(first[i + 1] - first[i], src[links] - first[i], dst[links] - first[i])
            out[t] = centre[first[i] : first[i + 1]] - begins[i], np.where(m >= 0, m - first[i], -1), nei
        return out

    def models(self, params: Params, seed: int, among: np.ndarray) -> dict[int, list[tuple]]:
        """CYLINDER rows of one combination by tree code, of trees that got any. tree_id is the code."""
        out: dict[int, list[tuple]] = {}
        visit = visits(self.ids, seed)
        n = len(self.ids)
        patch, ball = params.patch_diam1[0], params.ball_rad1[0]
        covers = self.cover(ranked(self.ids, visit), np.full(n, patch), np.full(n, ball), params.nmin1, among)
        rs, first = np.full(n, np.nan), {}
        for t, cover in enumerate(covers):
            if cover is None or not len(cover[0]):
                continue
            at, member, nei = cover
            c = self.xyz[self.at[t] : self.at[t + 1]][at]
            before = list(nei)  # forest joins sets in place
            found = forest.grown(nei, c, base_sets(c), np.zeros(len(c), int), np.zeros(len(c), bool), patch, True, False, True)
            rows, up = listed(found), np.array([s[1] for s in found])
            size = relative_sizes(rows, up, before, c[:, 2])
            rs[self.at[t] : self.at[t + 1]] = np.where(member >= 0, size[member], np.nan)
            of_set = least_of(len(c), rows[:, 2], rows[:, 0])
            first[t] = np.where(member >= 0, of_set[member], -1), main_segments(up)
        if not first:
            return out
        patch, ball, share = params.patch_diam2_max[0], params.ball_rad2[0], params.patch_diam2_min[0] / params.patch_diam2_max[0]
        part = rs / 256 * (1 - share) + share
        reach = patch * part
        held = np.zeros(len(self.at) - 1, bool)
        held[[*first]] = True
        covers = self.cover(ranked(self.ids, visit, np.where(rs <= 32, 0, np.where(rs <= 128, 1, 2))), reach, reach + np.sqrt(part) * (ball - patch), params.nmin2, held)
        for t, (of_point, main) in first.items():
            at, member, nei = covers[t]
            if not len(at):
                continue
            xyz, ids = self.xyz[self.at[t] : self.at[t + 1]], self.ids[self.at[t] : self.at[t + 1]]
            c = xyz[at]
            some = (member >= 0) & (of_point >= 0)
            of_set = least_of(len(c), member[some], of_point[some])
            on, start = of_set == 0, np.zeros(0, int)
            if on.any():
                low = c[on, 2].min()
                start = np.flatnonzero(on & ((c[:, 2] < low + min(1.5, 0.02 * np.ptp(c[:, 2]))) | (c[:, 2] == low)))
            segment = np.where((of_set >= 0) & main[of_set], of_set + 1, 0)
            found = forest.grown(nei, c, start, segment, np.zeros(len(c), bool), patch, True, True, False)
            rows = listed(found)
            fits, by_set, inside = [], np.argsort(member, kind="stable"), np.searchsorted(np.sort(member), np.arange(len(c) + 1))
            for s in range(len(found)):
                own = rows[rows[:, 0] == s]
                p = [by_set[inside[i] : inside[i + 1]] for i in own[:, 2]]
                layer, point = np.repeat(own[:, 1], [len(x) for x in p]), np.concatenate(p)
                order = np.lexsort((ids[point], layer))
                got = stems.segment_cylinders(xyz[point[order]], layer[order], member[point])
                if got:
                    fits.append((s + 1, found[s][1] + 1, got))
            rows = stems.hang_all(t, fits)
            if rows:
                out[t] = adjusted(xyz, rows, params)
        return out
