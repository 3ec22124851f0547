"""Kernels on the cover sets of one tree: trunk, connectivity, segments and their corrections.

Sets are numbered 0 to n - 1; `nei` is a list of arrays of neighbours, `z` or `c` are centres. Everything here follows one
frontier at a time, so it runs as one function per tree; sets are thousands where points are millions.
"""

from __future__ import annotations

from collections import deque

import numpy as np

#: Layers that a frontier is followed ahead, at most.
AHEAD = 6
#: Farthest that a component is joined to the tree over a gap; components this far off are no part of it.
FAR = 12.0


def neighbour_lists(n: int, src: np.ndarray, dst: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(src, kind="stable")
    ends = np.searchsorted(src[order], np.arange(n + 1))
    d = dst[order]
    return [d[ends[i] : ends[i + 1]] for i in range(n)]


def around(nei: list[np.ndarray], sets: np.ndarray, free: np.ndarray) -> np.ndarray:
    """The different neighbours of sets that are free and not among them."""
    if not len(sets):
        return np.zeros(0, int)
    found = np.unique(np.concatenate([nei[i] for i in sets]))
    return np.setdiff1d(found[free[found]], sets)


def parts(nei: list[np.ndarray], sets: np.ndarray) -> list[np.ndarray]:
    """Connected components of the sets."""
    left, out = {*sets.tolist()}, []
    while left:
        first = left.pop()
        queue, one = deque([first]), [first]
        while queue:
            for j in nei[queue.popleft()].tolist():
                if j in left:
                    left.remove(j)
                    queue.append(j)
                    one.append(j)
        out.append(np.array(sorted(one)))
    return sorted(out, key=lambda x: int(x[0]))


def connect(nei: list[np.ndarray], a: int, b: int) -> None:
    nei[a], nei[b] = np.append(nei[a], b), np.append(nei[b], a)


def nearest(c: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[float, int, int]:
    """The closest pair of two groups of sets. The larger is put in order along its longest side, and each set of the smaller
    looks only at those no farther along it than the closest pair so far."""
    if not len(a) or not len(b):
        return np.inf, -1, -1
    few, many = (a, b) if len(a) <= len(b) else (b, a)
    side = int(np.ptp(c[many], axis=0).argmax())
    many = many[np.argsort(c[many, side], kind="stable")]
    at, p = c[many, side], c[many]
    best, i, j = np.inf, -1, -1
    for k in few.tolist():
        lo, hi = np.searchsorted(at, c[k, side] - best), np.searchsorted(at, c[k, side] + best, "right")
        if lo < hi:
            d = ((p[lo:hi] - c[k]) ** 2).sum(1)
            m = int(d.argmin())
            if d[m] < best**2:
                best, i, j = float(d[m]) ** 0.5, k, int(many[lo + m])
    return (best, i, j) if len(a) <= len(b) else (best, j, i)


def trunk(nei: list[np.ndarray], c: np.ndarray, base: np.ndarray, band: float = 0.25, jump: float = 2.0, top_share: float = 1.0) -> np.ndarray:
    """Sets of the trunk: the base followed upwards through neighbours no lower than a band below what was reached. Where the
    way ends, a gap of up to `jump` is bridged by joining the steepest nearest set above; nei is changed there."""
    mask = np.zeros(len(c), bool)
    mask[base] = True
    front = base
    limit = c[:, 2].min() + top_share * np.ptp(c[:, 2])
    while True:
        reached = c[mask, 2].max()
        new = around(nei, front, ~mask)
        new = new[c[new, 2] > reached - band]
        if len(new):
            mask[new] = True
            front = new
            continue
        if reached >= limit - band:
            return np.flatnonzero(mask)
        tops = np.flatnonzero(mask & (c[:, 2] > reached - band))
        above = np.flatnonzero(~mask & (c[:, 2] > reached) & (c[:, 2] < reached + jump))
        if not len(above):
            return np.flatnonzero(mask)
        best = None
        for i in tops.tolist():  # the steepest way, by steps of 0.05 below a cosine of 0.7, then the shortest
            way = c[above] - c[i]
            d = np.maximum(np.linalg.norm(way, axis=1), 1e-12)
            lacking = np.maximum(0, np.floor((0.7 - way[:, 2] / d) / 0.05) + 1)
            j = int(np.lexsort((d, lacking))[0])
            if best is None or (lacking[j], d[j]) < best[:2]:
                best = (lacking[j], d[j], i, int(above[j]))
        if best[1] > jump:
            return np.flatnonzero(mask)
        connect(nei, best[2], best[3])
        mask[best[3]] = True
        front = np.array([best[3]])


def join_branches(nei: list[np.ndarray], c: np.ndarray, segment: np.ndarray) -> None:
    """Sets of one earlier segment (numbers over 0, the stem is 1) are made connected by their closest pairs, smallest
    component first; then each segment is joined to the stem's closest set if none of its sets touches another segment."""
    for s in np.unique(segment[segment > 0]):
        groups = parts(nei, np.flatnonzero(segment == s))
        while len(groups) > 1:
            groups.sort(key=len)
            one = groups.pop(0)
            k, (_, a, b) = min(((k, nearest(c, one, g)) for k, g in enumerate(groups)), key=lambda x: x[1][0])
            connect(nei, a, b)
            groups[k] = np.concatenate([groups[k], one])
        own = np.flatnonzero(segment == s)
        if s > 1 and (segment == 1).any() and not (segment[np.concatenate([nei[i] for i in own] or [np.zeros(0, int)])] != s).any():
            _, a, b = nearest(c, own, np.flatnonzero(segment == 1))
            connect(nei, a, b)


def make_connected(nei: list[np.ndarray], c: np.ndarray, start: np.ndarray, forbidden: np.ndarray, patch: float, only_tree: bool = True) -> np.ndarray:
    """The mask of sets of the tree. From the start's component on, other components are joined by their closest pairs.

    The reach grows by 20 cm (10 patches at most) whenever nothing more can be decided within it. A component that touches
    forbidden sets (the ground), lies within a third of its distance to the tree from them, or nearer to them than to the tree
    and over 25 cm off, becomes forbidden, in place; so does one FAR off and, in plots with ground, a small one over half a
    metre off: of under 10 cm of patches first, three times that with each growth of the reach. One within reach of the tree
    is joined; a tall one that begins low by its bottom.
    """
    tree = np.zeros(len(c), bool)
    front = start
    while len(front):
        tree[front] = True
        front = around(nei, front, ~tree & ~forbidden)
    step = min(10, int(np.ceil(0.2 / patch)))
    k, least = step, 0 if only_tree else int(np.ceil(0.1 / patch))
    bottom = float(c[start, 2].min()) if len(start) else float(c[:, 2].min())
    groups = parts(nei, np.flatnonzero(~tree & ~forbidden))
    low = []  # a tall component is joined to what is no higher than half a metre over its bottom
    for g in groups:
        z = c[g, 2]
        tall = len(g) > 100 and np.ptp(z) > 5 and z.min() < bottom + 5
        low.append(float(z.min()) + 0.5 if tall else np.inf)

    def closest(i: int, to: np.ndarray) -> tuple[float, int, int]:
        return nearest(c, groups[i], to[c[to, 2] < low[i]])

    open_ = dict.fromkeys(range(len(groups)))
    on = {i: closest(i, np.flatnonzero(tree)) for i in open_}
    off = {i: closest(i, np.flatnonzero(forbidden))[0] for i in open_}
    while open_:
        changed = True
        while changed:
            changed = False
            for i in [*open_]:
                g, (dt, a, b), df = groups[i], on[i], off[i]
                seen = 2 * k * patch  # what lies farther isn't looked at yet
                dt, df = dt if dt <= seen else np.inf, df if df <= seen else np.inf
                touches = forbidden[np.concatenate([nei[j] for j in g])].any()
                if touches or FAR < dt < np.inf or (len(g) < least and 0.5 < dt < 10) or 3 * df < dt or 0.25 < df < dt:
                    forbidden[g] = True
                    new, kind = g, False
                elif dt <= k * patch:
                    connect(nei, a, b)
                    tree[g] = True
                    new, kind = g, True
                else:
                    continue
                del open_[i]
                changed = True
                for j in open_:
                    d = closest(j, new)
                    if kind:
                        on[j] = min(on[j], d)
                    else:
                        off[j] = min(off[j], d[0])
        if k * patch > 100 or not any(min(on[i][0], off[i]) < np.inf for i in open_):
            for i in open_:
                forbidden[groups[i]] = True
            break
        k, least = k + step, 3 * least
    return tree


# --- segments --------------------------------------------------------------------------------------------------------


def study(nei: list[np.ndarray], cut: np.ndarray, free: np.ndarray, layers: int) -> list[tuple[np.ndarray, np.ndarray, bool]]:
    """The connected components of what lies within so many layers from a frontier on: (sets, those of the frontier, whether
    a way leads on from the last layer). Parts of the frontier that meet within these layers are in one component."""
    free = free.copy()
    free[cut] = False
    region = [cut]
    while len(region) < layers and len(front := around(nei, region[-1], free)):
        free[front] = False
        region.append(front)
    out = []
    for sets in parts(nei, np.concatenate(region)):
        end = np.intersect1d(sets, region[-1])
        out.append((sets, np.intersect1d(sets, cut), bool(len(around(nei, end, free)))))
    return out


def branches_off(found: list[tuple[np.ndarray, np.ndarray, bool]], cut: int) -> list[bool]:
    """Which components of a study begin branches.

    One without a way on stays if it is no larger than its base, is of one set and another, has a base of under 5 % of the
    frontier and at most as much again, or is of three sets at most. One with 70 % of the frontier, or of the study, goes
    on as the segment. If none does, the largest of the others does.
    """
    whole = sum(len(sets) for sets, _, _ in found)
    out, goes_on = [], False
    for sets, base, more in found:
        size, b = len(sets), len(base)
        if not more and (size == b or (b == 1 and size <= 2) or (b / cut < 0.05 and 2 * b >= size) or size <= 3):
            out.append(False)
        elif b / cut >= 0.7 or size >= 0.7 * whole:
            out.append(False)
            goes_on = True
        else:
            out.append(True)
    if not goes_on and any(out):
        out[max((i for i, yes in enumerate(out) if yes), key=lambda i: (len(found[i][0]), -i))] = False
    return out


def segments(nei: list[np.ndarray], base: np.ndarray, forbidden: np.ndarray) -> list[tuple[list[np.ndarray], int, int]]:
    """Segments as (layers, parent segment or -1, the parent's layer that it leaves from), parents first.

    A segment grows by its frontier. Where that falls apart, what lies ahead is studied, as many layers as the segment's first
    frontier has sets and AHEAD at most; components that branch off give their sets of the frontier as bases of new
    segments, and this segment doesn't grow into them.
    """
    taken = forbidden.copy()  # by segments that are done, and by bases
    taken[base] = True
    out: list[tuple[list[np.ndarray], int, int]] = []
    queue = deque([(base, -1, -1)])
    while queue:
        first, parent, at = queue.popleft()
        layers, me, barred, far = [first], len(out), taken.copy(), 0
        out.append((layers, parent, at))
        while True:
            barred[layers[-1]] = True
            cut = around(nei, layers[-1], ~barred)
            if not len(cut):
                break
            far = far or min(len(cut), AHEAD)
            if len(parts(nei, cut)) > 1:
                found = study(nei, cut, ~barred, far)
                if len(found) > 1:
                    for (sets, own, _), yes in zip(found, branches_off(found, len(cut)), strict=True):
                        if yes:
                            queue.append((own, me, len(layers) - 1))
                            taken[own] = True
                            barred[sets] = True
                    cut = cut[~barred[cut]]
                    if not len(cut):
                        break
            layers.append(cut)
        taken[np.concatenate(layers)] = True
    return out


class Segments:
    """Segments while their topology changes: layers; the segment that each leaves, and its layer; those that leave it."""

    def __init__(self, segs: list):
        self.layers = [list(s[0]) for s in segs]
        self.parent, self.at = [s[1] for s in segs], [s[2] for s in segs]
        self.children: list[list[int]] = [[] for _ in segs]
        for i, p in enumerate(self.parent):
            if p >= 0:
                self.children[p].append(i)

    def under(self, i: int) -> list[int]:
        """i and all that stem from it, nearer ones first."""
        out = [i]
        for k in out:
            out += self.children[k]
        return out

    def path(self, i: int, tip: int) -> list[int]:
        """From i's child to the tip."""
        out = []
        while tip != i:
            out.append(tip)
            tip = self.parent[tip]
        return out[::-1]

    def way(self, i: int, tip: int) -> list[np.ndarray]:
        """The layers of i if it led to the tip. What leaves the last layer but one, or later, goes on from the end."""
        out, path = list(self.layers[i]), self.path(i, tip)
        shift = 0  # where the layers of the path's segment before begin in out
        for n, k in enumerate(path):
            leaves = shift + self.at[k] + 1
            if leaves < len(out) - 1:
                out = out[:leaves]
            shift = len(out)
            upto = self.at[path[n + 1]] + 1 if n + 1 < len(path) else len(self.layers[k])
            out += self.layers[k][:upto]
        return out

    def extend(self, i: int, tip: int) -> None:
        """i leads on to the tip; what it loses or passes by becomes its child."""
        path = self.path(i, tip)
        for n, k in enumerate(path):
            last = n + 1 == len(path)
            self.absorb(i, k, len(self.layers[k]) if last else self.at[path[n + 1]] + 1, 3 if last else 2)

    def absorb(self, i: int, k: int, upto: int, slack: int) -> None:
        """i goes on with the first layers of its child k. The rest of i becomes a child of its own, unless k leaves so near the
        end that no more than `slack` layers are left."""
        leaves = self.at[k] + 1
        self.children[i].remove(k)
        if leaves < len(self.layers[i]) - slack:
            rest = len(self.layers)
            self.layers.append(self.layers[i][leaves:])
            self.layers[i] = self.layers[i][:leaves]
            self.parent.append(i)
            self.at.append(leaves - 1)
            self.children.append([j for j in self.children[i] if self.at[j] >= leaves])
            self.children[i] = [j for j in self.children[i] if self.at[j] < leaves] + [rest]
            for j in self.children[rest]:
                self.parent[j], self.at[j] = rest, self.at[j] - leaves
        before = len(self.layers[i])
        self.layers[i] += self.layers[k][:upto]
        self.layers[k] = self.layers[k][upto:]
        stay = []
        for j in self.children[k]:
            if self.at[j] < upto:
                self.parent[j], self.at[j] = i, self.at[j] + before
                self.children[i].append(j)
            else:
                self.at[j] -= upto
                stay.append(j)
        self.children[k] = stay
        if self.layers[k]:
            self.at[k] = before + upto - 1
            self.children[i].append(k)
        else:
            self.parent[k] = -1

    def listed(self) -> list[tuple[list[np.ndarray], int, int]]:
        """As segments() gives them, parents first."""
        out, number = [], {}
        for i in self.under(0):
            number[i] = len(out)
            out.append((self.layers[i], number.get(self.parent[i], -1), self.at[i] if self.parent[i] >= 0 else -1))
        return out


def run_length(c: np.ndarray, layers: list[np.ndarray], every: int) -> tuple[float, float]:
    """(length, span) of the line through the middles of every so many layers and of the last one."""
    at = [*range(0, len(layers), every)]
    if at[-1] != len(layers) - 1 or len(at) == 1:
        at.append(len(layers) - 1)
    m = np.array([c[layers[k]].mean(0) for k in at])
    return float(np.linalg.norm(np.diff(m, axis=0), axis=1).sum()), float(np.linalg.norm(m[-1] - m[0]))


def stem_top(t: Segments, c: np.ndarray, patch: float) -> int:
    """The segment that the stem should end with: of the tips near the place at the tree's greatest height above the stem's
    base, the one of the straightest way. Farther tips, and then less straight ways, are taken where none is straight."""
    ids = t.under(0)
    tips = np.array([c[t.layers[i][-1][0]] for i in ids])
    base = c[t.layers[0][0]].mean(0)
    far = np.hypot(np.linalg.norm(tips[:, :2] - base[:2], axis=1), tips[:, 2].max() - tips[:, 2])
    every = int(np.ceil(0.5 / patch / 1.4))
    within, most = 0.5, 1.05
    while True:
        within = max(within, 0.5 * (np.floor(far.min() / 0.5) + 1))
        ratios = {}
        for i in np.flatnonzero(far < within).tolist():
            length, span = run_length(c, t.way(0, ids[i]), every)
            ratios[ids[i]] = length / max(span, 1e-9)
        best = min(ratios, key=lambda i: (ratios[i], ids.index(i)))
        if ratios[best] <= most or within > 2 * far.max() + 8:
            return best
        within += 1
        most = 5.0 if within > 7 else 1.15 if within > 5 else 1.1 if within > 3 else most


def branch_top(t: Segments, c: np.ndarray, patch: float, i: int) -> int:
    """The segment that a branch of the stem should end with: of the tips over 75 % as far off as the farthest, the farthest whose
    way is less than 20 % longer than its distance; else the farthest with at most 40 %; else the farthest of all that aren't
    over 75 % as far off."""
    ids = t.under(i)
    base = c[t.layers[i][0]].mean(0)
    far = np.array([np.linalg.norm(c[t.layers[k][-1]].mean(0) - base) for k in ids])
    order = np.argsort(-far, kind="stable")
    every = int(np.ceil(0.25 / patch / 1.4))
    bend = {}
    for k in order.tolist():
        bend[k] = run_length(c, t.way(i, ids[k]), every)[0] / max(far[k], 1e-9)
        if bend[k] < 1.2 and far[k] > 0.75 * far.max():
            return ids[k]
    return ids[next((k for k in order.tolist() if bend[k] <= 1.4 or far[k] <= 0.75 * far.max()), int(order[0]))]


def lengthen(segs: list, c: np.ndarray, patch: float) -> list:
    """Segments re-stitched, from the stem outwards, so that the stem goes straight to the top, its branches straight to far
    tips, and branches of branches to their farthest tip."""
    t = Segments(segs)
    level, order = [0], 0
    while level:
        for i in level:
            if t.children[i]:
                if order == 0:
                    tip = stem_top(t, c, patch)
                elif order == 1:
                    tip = branch_top(t, c, patch, i)
                else:
                    ids, base = t.under(i), c[t.layers[i][0]].mean(0)
                    tip = max(ids, key=lambda k: float(((c[t.layers[k][-1][0]] - base) ** 2).sum()))  # noqa: B023
                t.extend(i, tip)
        level = [k for i in level for k in t.children[i]]
        order += 1
    return t.listed()


def off_axis(c: np.ndarray, sets: np.ndarray, low: np.ndarray, high: np.ndarray) -> float:
    """The greatest distance of sets from the line through the middles of two layers (a plumb line where they are one)."""
    a, way = c[low].mean(0), c[high].mean(0) - c[low].mean(0)
    n = np.linalg.norm(way)
    axis = way / n if n > 1e-9 else np.array([0.0, 0.0, 1.0])
    v = c[sets] - a
    return float(np.linalg.norm(v - (v @ axis)[:, None] * axis, axis=1).max())


def remove_small(segs: list, c: np.ndarray) -> list:
    """Without segments that hardly leave their parent, ten layers of which to either side give its axis and width: that go
    less than 2 cm, or 20 % and 6 cm, farther from the axis, and no more than 6 cm over the stem's width at its base (half of it on
    branches). Such a one stays if it has children, but for children without any that hardly leave the parent either."""
    layers, up, at = [s[0] for s in segs], [s[1] for s in segs], [s[2] for s in segs]
    children: list[list[int]] = [[] for _ in segs]
    for i, p in enumerate(up):
        if p >= 0:
            children[p].append(i)
    stem = layers[0][: min(10, len(layers[0]))]
    widest = off_axis(c, np.concatenate(stem), stem[0], stem[-1])
    gone: set[int] = set()
    for p in range(len(segs)):
        if p in gone:
            continue
        for i in children[p]:
            place = at[i] + 1  # counted from 1
            near = layers[p][max(0, place - 11) : place + 10]
            theirs = np.concatenate(near)
            own = off_axis(c, np.concatenate(layers[i]), near[0], near[-1])
            if own >= widest + 0.06:
                continue
            wide = off_axis(c, theirs, near[0], near[-1])
            hardly = lambda x: x - wide < 0.02 or (x / max(wide, 1e-12) < 1.2 and x - wide < 0.06)  # noqa: E731, B023
            if not hardly(own):
                continue
            small = [k for k in children[i] if k not in gone]
            if any(children[k] for k in small):
                continue
            if all(hardly(off_axis(c, np.concatenate([*layers[k], theirs]), near[0], near[-1])) for k in small):
                gone.update([i, *small])
        if p == 0:
            widest /= 2
    return keep(segs, [i for i in range(len(segs)) if i not in gone])


def keep(segs: list, ids: list[int]) -> list:
    number = {i: k for k, i in enumerate(ids)}
    return [(segs[i][0], number.get(segs[i][1], -1), segs[i][2]) for i in ids]


def direction(c: np.ndarray, layers: list[np.ndarray], place: int) -> np.ndarray:
    """From three layers before to two after a place of a segment; 0 where that is one layer."""
    low, high = max(0, place - 3), min(len(layers) - 1, place + 2)
    way = c[layers[high]].mean(0) - c[layers[low]].mean(0) if high > low else np.zeros(3)
    return way / max(np.linalg.norm(way), 1e-12)


def extend_bases(segs: list, c: np.ndarray, patch: float, add: bool) -> list:
    """Branches begin deeper in their parents: their bases are followed back through the parent's layers, three at least and the
    more the wider the base and the smaller the angle.

    Of a layer those sets go that lie within 1.25 base diameters of the branch's axis and, unless the branch runs along its
    parent, nearer to the base than to the layer's middle; where all or none would, it ends. With `add` the sets become the
    branch's base; without, they leave the parents of branches other than the stem.
    """
    segs = [(list(s[0]), s[1], s[2]) for s in segs]
    for layers, p, at in segs:
        if p < 0 or (p == 0 and not add):
            continue
        base, way = layers[0], direction(c, layers, 0)
        middle = c[base].mean(0)
        v = c[base] - middle
        wide = 2 * float(np.linalg.norm(v - (v @ way)[:, None] * way, axis=1).max()) if len(base) > 1 else patch
        cosine = abs(float(way @ direction(c, segs[p][0], at)))
        new = [base]
        for k in range(at, at - min(at + 1, max(3, int(np.ceil(cosine * 2 * wide / patch)))), -1):
            own = segs[p][0][k]
            v = c[own] - middle
            move = np.linalg.norm(v - (v @ way)[:, None] * way, axis=1) < 1.25 * wide
            if cosine < 0.9:
                move &= np.linalg.norm(v, axis=1) < 1.1 / (1 - 0.5 * cosine**2) * np.linalg.norm(c[own] - c[own].mean(0), axis=1)
            if move.all() or not move.any():
                break
            segs[p][0][k] = own[~move]
            new.append(own[move])
        if add:
            layers[0] = np.sort(np.concatenate(new))
    return segs


def correct(segs: list, c: np.ndarray, patch: float, small: bool, bases: bool, add: bool) -> list:
    """Lengthened segments, without small ones and with extended bases as asked; `add` gives what bases gain to the branches."""
    out = lengthen(segs, c, patch)
    if small:
        out = remove_small(out, c)
    return extend_bases(out, c, patch, add) if bases else out


def grown(nei: list[np.ndarray], c: np.ndarray, start: np.ndarray, segment: np.ndarray, forbidden: np.ndarray, patch: float, only_tree: bool, small: bool, add: bool) -> list:
    """Corrected segments of one tree's sets, made one component from the base `start` (the lowest set, if there is none).
    segment: numbers of an earlier segmentation's stem and main branches, which are made connected first, or zeros."""
    if not len(start):
        start = np.array([int(c[:, 2].argmin())])
    forbidden[start] = False
    if segment.any():
        join_branches(nei, c, segment)
    else:
        trunk(nei, c, start)
    make_connected(nei, c, start, forbidden, patch, only_tree)
    return correct(segments(nei, start, forbidden), c, patch, small, True, add)
