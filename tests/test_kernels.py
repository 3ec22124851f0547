import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sylva.functions import fitting, forest, hulls, stems
from sylva.operators.cylinders import allometry_fit


def cylinder(rng, n, axis, radius=0.1, length=1.0, noise=0.0, arc=2 * np.pi):
    a = np.asarray(axis, float) / np.linalg.norm(axis)
    u, v = fitting.basis(a)
    t, h = rng.uniform(0, arc, n), rng.uniform(0, length, n)
    return np.array([1.0, 2.0, 3.0]) + h[:, None] * a + radius * (np.cos(t)[:, None] * u + np.sin(t)[:, None] * v) + rng.normal(0, noise, (n, 3)), a


@pytest.mark.parametrize("axis", [(0, 0, 1), (1, 1, 2), (1, 0, 0)])
@pytest.mark.parametrize("noise", [0.0, 0.001])
def test_cylinder(axis, noise):
    rng = np.random.default_rng(1)
    p, a = cylinder(rng, 1500, axis, noise=noise)
    guess = a + np.array([0.08, -0.05, 0.04])
    c = fitting.fit_cylinder(p, guess / np.linalg.norm(guess), p.mean(0), 0.12)
    assert c.converged and c.reliable and abs(c.radius - 0.1) < 1e-3 and abs(abs(c.axis @ a) - 1) < 1e-4
    assert c.coverage > 0.97 and abs(c.length - 1) < 0.02 and c.mad < noise + 1e-6


def test_half_cylinder():
    p, a = cylinder(np.random.default_rng(2), 2000, (0, 0, 1), arc=np.pi)
    c = fitting.fit_cylinder(p, a, p.mean(0), 0.1)
    assert abs(c.radius - 0.1) < 2e-3 and 0.45 < c.coverage < 0.6


def test_derivatives():
    rng = np.random.default_rng(3)
    p, par = rng.normal(size=(20, 3)), np.array([0.1, -0.2, 0.05, 0.1, 0.4])
    _, j = fitting.cylinder_residuals(par, p)
    for k in range(5):
        d = np.zeros(5)
        d[k] = 1e-6
        numeric = (fitting.cylinder_residuals(par + d, p)[0] - fitting.cylinder_residuals(par - d, p)[0]) / 2e-6
        assert np.allclose(j[:, k], numeric, atol=1e-6)


def test_circles_and_axis():
    t = np.linspace(0, 2 * np.pi, 200, endpoint=False)
    q = np.column_stack([np.cos(t), np.sin(t)]) * 0.3 + [1, 2]
    c, r, mad, arcs, ok = fitting.fit_circle(q, [1.05, 1.98], 0.25)
    assert ok and np.allclose(c, [1, 2]) and abs(r - 0.3) < 1e-9 and mad < 1e-9 and arcs == 1
    c, mad, ok = fitting.fit_circle_centre(q, [1.05, 1.98], 0.3)
    assert ok and np.allclose(c, [1, 2], atol=1e-6)
    p, a = cylinder(np.random.default_rng(4), 500, (1, 2, 9))
    x, ok = fitting.fit_axis(p, np.array([0.0, 0.0, 1.0]), np.array([1.0, 2.0, 3.0]), 0.1)
    assert ok and abs(abs(x @ a) - 1) < 1e-5


@given(st.lists(st.floats(-1, 1), min_size=3, max_size=3).filter(lambda v: np.linalg.norm(v) > 0.01))
def test_rotations(v):
    v = np.array(v)
    r = fitting.rotate_to_z(v)
    assert np.allclose(r @ r.T, np.eye(3)) and np.allclose(r @ v, [0, 0, np.linalg.norm(v)], atol=1e-9) and np.linalg.det(r) > 0
    u, w = fitting.basis(v / np.linalg.norm(v))
    assert abs(u @ v) < 1e-9 and abs(w @ v) < 1e-9 and abs(u @ w) < 1e-9


def test_hulls():
    rng = np.random.default_rng(5)
    cube = np.array([[i, j, k] for i in (0, 1) for j in (0, 1) for k in (0, 1)], float)
    p = np.vstack([cube, rng.random((200, 3))])
    assert hulls.hull_3d_volume(p) == pytest.approx(1)
    corners = p[hulls.hull_2d(p[:, :2]), :2]
    assert hulls.polygon_area(corners) == pytest.approx(1) and np.allclose(hulls.polygon_centroid(corners), 0.5) and hulls.spread_diameter(corners) == pytest.approx(2**0.5)
    assert hulls.alpha_size(p[:, :2], 500.0) == pytest.approx(1, abs=0.01) and hulls.alpha_size(p, 500.0) == pytest.approx(1, abs=0.01)
    s = rng.normal(size=(500, 3))
    s /= np.linalg.norm(s, axis=1)[:, None]
    assert 4.0 < hulls.hull_3d_volume(s) < 4 / 3 * np.pi
    assert hulls.hull_3d_volume(cube[:4]) == 0 and hulls.hull_3d_volume(cube[:3]) == 0 and hulls.alpha_size(cube[:2], 1) == 0


def test_alpha_shape_leaves_the_gap():
    rng = np.random.default_rng(6)
    two = np.vstack([rng.random((150, 2)), rng.random((150, 2)) + [5, 0]])
    assert hulls.alpha_size(two, 0.5) == pytest.approx(2, abs=0.25)
    ring = rng.random((900, 2)) * 4
    ring = ring[(np.abs(ring - 2) > 1).any(1)]
    assert hulls.alpha_size(ring, 0.6) < 13.5 and hulls.alpha_size(ring, 0.6, fill=True) == pytest.approx(16, abs=1)


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10_000))
def test_delaunay_circles_are_empty(seed):
    p = np.unique(np.random.default_rng(seed).random((25, 2)), axis=0)
    s, r = hulls.delaunay(p)
    for t, radius in zip(s, r, strict=True):
        a, b, c = p[t]
        m = np.linalg.solve(2 * np.array([b - a, c - a]), np.array([b @ b - a @ a, c @ c - a @ a]))
        assert (np.linalg.norm(p - m, axis=1) > radius * (1 - 1e-4) - 1e-6).all()


def tree():
    g = [[0.1 * np.cos(a), 0.1 * np.sin(a), h] for h in np.arange(0, 4, 0.1) for a in range(6)]
    g += [[s * q * 0.7 + 0.05 * np.cos(a * 1.5), 0.05 * np.sin(a * 1.5), 2 + q * 0.7] for s in (1, -1) for q in np.arange(0.1, 2, 0.1) for a in range(4)]
    g = np.array(g)
    d = ((g[:, None] - g[None]) ** 2).sum(-1)
    return g, forest.neighbour_lists(len(g), *np.nonzero((d < 0.16**2) & (d > 0)))


def test_segments_of_a_y_tree():
    g, nei = tree()
    base = np.flatnonzero(g[:, 2] < 0.05)
    found = forest.correct(forest.segments(nei, base, np.zeros(len(g), bool)), g, 0.1, True, True, False)
    assert len(found) == 3 and [s[1] for s in found] == [-1, 0, 0]
    every = np.concatenate([x for s in found for x in s[0]])
    assert len(every) == len(np.unique(every)) == len(g)
    assert g[found[0][0][-1], 2].max() > 3.8


def test_parents_come_first_and_layers_exist():
    rng = np.random.default_rng(7)
    for _ in range(10):
        g = rng.random((300, 3)) * [1, 1, 3]
        d = ((g[:, None] - g[None]) ** 2).sum(-1)
        nei = forest.neighbour_lists(len(g), *np.nonzero((d < 0.3**2) & (d > 0)))
        base = np.flatnonzero(g[:, 2] < 0.2)
        forbidden = np.zeros(len(g), bool)
        tree_ = forest.make_connected(nei, g, base, forbidden, 0.2)
        segs = forest.segments(nei, base, forbidden)
        assert sum(len(x) for s in segs for x in s[0]) == tree_.sum()
        for fixed in (segs, forest.correct(segs, g, 0.2, False, False, False), forest.correct(segs, g, 0.2, True, True, False), forest.correct(segs, g, 0.2, False, True, True)):
            for i, (layers, p, at) in enumerate(fixed):
                assert p < i and all(len(x) for x in layers) and (p < 0 or 0 <= at < len(fixed[p][0]))
        assert sum(len(x) for s in forest.lengthen(segs, g, 0.2) for x in s[0]) == tree_.sum()


def test_trunk_bridges_gaps():
    g = np.array([[0, 0, h] for h in np.r_[np.arange(0, 1, 0.1), np.arange(1.8, 3, 0.1)]])
    d = ((g[:, None] - g[None]) ** 2).sum(-1)
    nei = forest.neighbour_lists(len(g), *np.nonzero((d < 0.15**2) & (d > 0)))
    assert len(forest.trunk(nei, g, np.array([0]))) == len(g)


def test_stem_surface():
    rng = np.random.default_rng(8)
    t, z = rng.uniform(0, 2 * np.pi, 8000), rng.uniform(0, 3, 8000)
    r = 0.2 - 0.02 * z
    p = np.column_stack([r * np.cos(t), r * np.sin(t), z])
    v, f, low = stems.stem_surface(p, 0.1, 0.04)
    tall = v[:, 2].max() - v[:, 2].min()
    a, b = 0.2 - 0.02 * v[:, 2].min(), 0.2 - 0.02 * v[:, 2].max()
    assert stems.volume(v, f) == pytest.approx(1000 * np.pi / 3 * tall * (a * a + a * b + b * b), rel=0.03)
    edges = np.sort(np.concatenate([f[:, [0, 1]], f[:, [1, 2]], f[:, [2, 0]]]), axis=1)
    assert (np.unique(edges, axis=0, return_counts=True)[1] == 2).all()  # closed
    assert stems.stem_surface(p[:5], 0.1, 0.04) is None


def test_self_crossing():
    square = np.array([[0, 0], [1, 0], [1, 1], [0, 1]], float)
    assert not stems.crosses_itself(square) and stems.crosses_itself(square[[0, 1, 3, 2]])


def test_segment_fit_follows_taper():
    rng = np.random.default_rng(9)
    t, z = rng.uniform(0, 2 * np.pi, 8000), rng.uniform(0, 5, 8000)
    r = 0.2 - 0.02 * z
    p = np.column_stack([r * np.cos(t), r * np.sin(t), z])
    found = stems.fit_segment(p, (z / 0.15).astype(int))
    assert all(abs(c.radius - (0.2 - 0.02 * (c.start[2] + c.length / 2))) < 0.005 for c in found) and sum(c.length for c in found) == pytest.approx(5, abs=0.2)


def test_allometry():
    v = np.random.default_rng(10).uniform(0.001, 1, 300)
    a, b, c = allometry_fit(v, 0.3 * v**0.4 + 0.01)
    assert np.allclose([a, b, c], [0.3, 0.4, 0.01], atol=1e-3)


def test_crowns_are_of_all_points(spark):
    from sylva.operators import kernels

    rng = np.random.default_rng(8)
    p = rng.uniform(0, 1, (500, 3)) * (6, 6, 8)
    df = spark.createDataFrame([(1, i, *map(float, q)) for i, q in enumerate(p)], "tree_id long, point_id long, x double, y double, z double")
    got = kernels.crowns(df).first()
    corners = p[hulls.hull_2d(p[:, :2]), :2]
    v = p[:, :2] - hulls.polygon_centroid(corners)
    sector = np.floor((np.degrees(np.arctan2(v[:, 1], v[:, 0])) + 180) / 10).clip(0, 35)
    mean = sum(np.linalg.norm(v[sector == s], axis=1).max() for s in set(sector)) / 18
    assert got.area_alpha == pytest.approx(hulls.alpha_size(p[:, :2], max(0.5, mean / 10)))
    assert got.volume_alpha == pytest.approx(hulls.alpha_size(p, max(0.5, mean / 5), fill=True))


# --- rules of segmentation, one by one --------------------------------------------------------------------------------


def lattice(columns):
    """Sets and neighbours of columns of sets: (x, y, from height, to height); sets less than 0.15 apart are neighbours."""
    g = np.array([[x, y, h] for x, y, low, high in columns for h in np.arange(low, high, 0.1)])
    d = ((g[:, None] - g[None]) ** 2).sum(-1)
    return g, forest.neighbour_lists(len(g), *np.nonzero((d < 0.15**2) & (d > 0)))


def thick_stem(n=60, height=3.0):
    return [(n * 0.1 / 2 / np.pi * np.cos(a), n * 0.1 / 2 / np.pi * np.sin(a), 0, height) for a in np.linspace(0, 2 * np.pi, n, endpoint=False)]


def test_thin_branch_on_a_thick_stem_goes_on():
    """A branch that begins with under 5 % of a stem's frontier but leads on is one; a stump of two sets isn't."""
    columns = thick_stem()
    r = columns[0][0]
    side = [(r + 0.1 * k, 0, 1.5 + 0.1 * k, 1.5 + 0.1 * k + 0.05) for k in range(1, 40)]  # straight out and up, a set a layer
    g, nei = lattice(columns + side)
    far = np.flatnonzero(g[:, 0] > r + 1.0)
    base = np.flatnonzero(g[:, 2] < 0.05)
    found = forest.segments(nei, base, np.zeros(len(g), bool))
    of = {int(i): s for s, (layers, _, _) in enumerate(found) for x in layers for i in x}
    assert {of[int(i)] for i in far} == {of[int(far[0])]} and of[int(far[0])] != 0
    g, nei = lattice(columns + side[:2])
    found = forest.segments(nei, np.flatnonzero(g[:, 2] < 0.05), np.zeros(len(g), bool))
    assert len(found) == 1


@pytest.mark.parametrize(
    ("found", "cut", "want"),
    [
        ([(9, 9, False), (40, 5, True)], 14, [False, False]),  # no larger than its base; the other is 70 % of the study
        ([(2, 1, False), (20, 5, True), (21, 6, True)], 12, [False, True, False]),  # one set and another; the largest goes on
        ([(8, 4, False), (90, 90, True)], 94, [False, False]),  # under 5 % and at most as much again
        ([(9, 4, False), (90, 90, True)], 94, [True, False]),  # more than that
        ([(8, 4, True), (90, 90, True)], 94, [True, False]),  # leads on
        ([(3, 2, False), (10, 5, True), (10, 5, True)], 12, [False, False, True]),  # three sets; of equals the first goes on
        ([(3, 2, True), (10, 5, True), (12, 5, True)], 12, [True, True, False]),
    ],
)
def test_what_branches_off(found, cut, want):
    assert forest.branches_off([(np.arange(n), np.arange(b), more) for n, b, more in found], cut) == want


def test_parts_that_meet_again_are_one():
    """A frontier that falls apart round a hole and closes within the layers studied."""
    columns = [(0.1 * k, 0, 0, 3.0) for k in range(6)]
    hole = [c for c in columns if c[0] not in (0.2, 0.30000000000000004)] + [(0.2, 0, 0, 1.0), (0.3, 0, 0, 1.0), (0.2, 0, 1.25, 3.0), (0.3, 0, 1.25, 3.0)]
    g, nei = lattice(hole)
    assert len(forest.segments(nei, np.flatnonzero(g[:, 2] < 0.05), np.zeros(len(g), bool))) == 1
    open_ = [c for c in columns if c[0] not in (0.2, 0.30000000000000004)] + [(0.2, 0, 0, 1.0), (0.3, 0, 0, 1.0)]
    g, nei = lattice(open_)
    assert len(forest.segments(nei, np.flatnonzero(g[:, 2] < 0.05), np.zeros(len(g), bool))) == 2


def line(a, b, n):
    return np.linspace(a, b, n)


def chains(*ways):
    """Segments of one set a layer from (points, parent, at)."""
    c = np.vstack([w for w, _, _ in ways])
    ends = np.cumsum([len(w) for w, _, _ in ways])
    return [([np.array([i]) for i in range(e - len(w), e)], p, at) for (w, p, at), e in zip(ways, ends, strict=True)], c


def tip(segs, c, i):
    return c[segs[i][0][-1][0]]


def test_stem_goes_straight_to_the_top():
    """The stem's first segment bends away; its straight continuation began as a branch."""
    segs, c = chains((np.vstack([line([0, 0, 0], [0, 0, 4], 40), line([0.1, 0, 4], [4, 0, 5], 40)]), -1, -1), (line([0, 0, 4.1], [0, 0, 9], 49), 0, 39))
    out = forest.lengthen(segs, c, 0.1)
    assert np.allclose(tip(out, c, 0), [0, 0, 9]) and np.allclose(tip(out, c, 1), [4, 0, 5]) and out[1][1:] == (0, 39)
    assert sum(len(x) for s in out for x in s[0]) == len(c)


def test_branches_go_straight_and_far():
    """A branch of the stem takes the straight way of nearly the same reach; one of a branch the farthest tip."""
    stem = (line([0, 0, 0], [0, 0, 8], 80), -1, -1)
    branch = (np.vstack([line([0.1, 0, 3], [2, 0, 3], 20), line([2, 0.1, 3], [2, 2.4, 3], 23), line([2.1, 2.4, 3], [3.2, 0.3, 3], 23)]), 0, 30)
    straight = (line([2.1, 0, 3], [3, 0, 3], 9), 1, 19)
    out = forest.lengthen(*chains(stem, branch, straight), 0.1)
    segs, c = chains(stem, branch, straight)
    assert np.allclose(tip(out, c, 1), [3, 0, 3]) and len(out) == 3
    twig = (np.vstack([line([0.1, 0, 3], [2, 0, 3], 20)]), 0, 30)
    second = (np.vstack([line([1, 0.1, 3], [1, 0.5, 3], 5)]), 1, 9)
    third = (line([1.1, 0.5, 3], [1.5, 0.9, 3], 8), 2, 4)
    segs, c = chains(stem, twig, second, third)
    out = forest.lengthen(segs, c, 0.1)
    assert len(out) == 3 and np.allclose(tip(out, c, 2), [1.5, 0.9, 3]) and len(out[2][0]) == 13


def test_ways_are_what_segments_become():
    rng = np.random.default_rng(9)
    for _ in range(50):
        ways, n = [(rng.random((int(rng.integers(8, 20)), 3)), -1, -1)], int(rng.integers(2, 7))
        for _ in range(n):
            p = int(rng.integers(0, len(ways)))
            ways.append((rng.random((int(rng.integers(5, 12)), 3)), p, int(rng.integers(0, len(ways[p][0]) - 4))))
        segs, c = chains(*ways)
        for t in range(1, len(segs)):
            s = forest.Segments(segs)
            want = s.way(0, t)
            s.extend(0, t)
            if all(len(segs[k][0]) - segs[j][2] > 5 for j in range(1, len(segs)) for k in [segs[j][1]]):  # no end is near
                assert [x.tolist() for x in s.layers[0]] == [x.tolist() for x in want]
            out = s.listed()
            assert sorted(int(i) for x, _, _ in out for y in x for i in y) == [*range(len(c))]
            assert all(p < i and (p < 0 or 0 <= at < len(out[p][0])) for i, (_, p, at) in enumerate(out))


def test_small_segments_go():
    ring = lambda r, h, n=8: [[r * np.cos(a), r * np.sin(a), h] for a in np.linspace(0, 2 * np.pi, n, endpoint=False)]
    c, segs = [], [([], -1, -1)]

    def add(points):
        c.extend(points)
        return np.arange(len(c) - len(points), len(c))

    for k in range(30):
        segs[0][0].append(add(ring(0.2, 0.1 * k)))
    segs.append(([add([[0.21, 0, 1.0]]), add([[0.215, 0, 1.1]])], 0, 9))  # hardly leaves the stem
    segs.append(([add([[0.3, 0, 1.5]]), add([[0.6, 0, 1.6]]), add([[0.9, 0, 1.7]])], 0, 14))  # leaves it
    segs.append(([add([[0.6, 0.01, 1.605]]), add([[0.6, 0.005, 1.605]])], 2, 1))
    segs.append(([add([[0.21, 0, 2.0]])], 0, 19))  # hardly leaves the stem, but its child does
    segs.append(([add([[0.5, 0, 2.1]]), add([[0.9, 0, 2.2]])], 4, 0))
    segs.append(([add([[0.205, 0, 2.5]])], 0, 24))  # neither does its child
    segs.append(([add([[0.207, 0, 2.6]])], 6, 0))
    out = forest.remove_small(segs, np.array(c))
    assert [s[0][0][0] for s in out] == [segs[i][0][0][0] for i in (0, 2, 4, 5)] and [s[1] for s in out] == [-1, 0, 0, 2]


def test_bases_are_followed_back():
    ring = [[0.2 * np.cos(a), 0.2 * np.sin(a), 0.1 * k] for k in range(20) for a in np.linspace(0, 2 * np.pi, 12, endpoint=False)]
    out = [[0.3 + 0.1 * k, y, 1.0 + 0.05 * k] for k in range(6) for y in (-0.05, 0, 0.05)]
    c = np.array(ring + out)
    segs = [([np.arange(12 * k, 12 * k + 12) for k in range(20)], -1, -1), ([np.arange(240 + 3 * k, 243 + 3 * k) for k in range(6)], 0, 10)]
    got = forest.extend_bases(segs, c, 0.1, True)
    gained = np.setdiff1d(got[1][0][0], segs[1][0][0])
    assert len(gained) and (c[gained, 0] > 0.1).all() and (np.abs(c[gained, 1]) < 0.15).all() and len(np.concatenate(got[0][0])) == 240 - len(gained)
    assert forest.extend_bases(segs, c, 0.1, False)[0][0][10].tolist() == segs[0][0][10].tolist()  # a stem keeps its sets
    deeper = [segs[0], segs[1], ([np.array([255])], 1, 3)]
    assert all(len(x) for s in forest.extend_bases(deeper, c, 0.1, False) for x in s[0])


def test_nearest_by_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(30):
        c = rng.random((80, 3)) * [1, 1, 20]
        a, b = np.split(rng.permutation(80), [int(rng.integers(1, 79))])
        d, i, j = forest.nearest(c, a, b)
        assert i in a and j in b and d == pytest.approx(np.linalg.norm(c[a][:, None] - c[b][None], axis=2).min()) == pytest.approx(np.linalg.norm(c[i] - c[j]))


def test_components_join_the_tree_or_the_ground():
    stem = np.array([[0, 0, h] for h in np.arange(0, 3, 0.1)])
    groups = {
        "near": [[0.5, 0, 2 + 0.1 * k] for k in range(5)],
        "beyond": [[0.95, 0, 2 + 0.1 * k] for k in range(5)],  # near to what is near
        "ground": [[2 + 0.1 * k, 0, 0] for k in range(20)],
        "shrub": [[3, 0, 0.4 + 0.1 * k] for k in range(4)],  # nearer to the ground
        "far": [[0, 20, 2 + 0.1 * k] for k in range(5)],
    }
    g = np.vstack([stem, *groups.values()])
    at, ends = {}, len(stem)
    for n, x in groups.items():
        at[n], ends = np.arange(ends, ends + len(x)), ends + len(x)
    d = ((g[:, None] - g[None]) ** 2).sum(-1)
    nei = forest.neighbour_lists(len(g), *np.nonzero((d < 0.15**2) & (d > 0)))
    forbidden = np.zeros(len(g), bool)
    forbidden[at["ground"]] = True
    tree = forest.make_connected(nei, g, np.array([0]), forbidden, 0.1, False)
    assert tree[at["near"]].all() and tree[at["beyond"]].all() and not tree[at["ground"]].any() and not tree[at["shrub"]].any() and not tree[at["far"]].any()
    assert (tree != forbidden).all() and len(forest.parts(nei, np.flatnonzero(tree))) == 1


def cyl(start, axis, length, radius):
    a = np.array(axis, float)
    return fitting.Cylinder(radius, length, np.array(start, float), a / np.linalg.norm(a), 0.0, 1.0, True, True)


STEM = [cyl([0, 0, 0.5 * k], [0, 0, 1], 0.5, 0.1) for k in range(6)]


def test_branches_begin_on_their_parents_surface():
    k, own, added = stems.hang([cyl([0.3, 0, 1.7], [1, 0, 0], 1, 0.03)], STEM)  # outside, followed back
    assert (k, added) == (3, False) and np.allclose(own[0].start, [0.1, 0, 1.7]) and own[0].length == pytest.approx(1.2)
    k, own, added = stems.hang([cyl([0.02, 0, 1.7], [1, 0, 0], 1, 0.03)], STEM)  # inside, followed on
    assert (k, added) == (3, False) and np.allclose(own[0].start, [0.1, 0, 1.7]) and own[0].length == pytest.approx(0.92)
    k, own, added = stems.hang([cyl([0.3, 0, 2.98], [1, 0, -0.2], 1, 0.03)], STEM)  # a little over the end
    assert (k, added) == (5, False) and own[0].start[2] == pytest.approx(3.02)
    assert stems.hang([cyl([5, 5, 5], [1, 0, 0], 1, 0.03)], STEM[:1])[0] == 0 and stems.hang(own, [])[0] is None


def test_cylinders_that_reach_no_parent():
    two = [cyl([0.3, 0, 3.4], [1, 0, 0.1], 0.5, 0.03), cyl([0.8, 0, 3.45], [1, 0, 0], 0.6, 0.03)]
    k, own, _ = stems.hang(two, STEM)  # passes over the end, near: the second cylinder begins at the crossing
    assert k == 5 and len(own) == 1 and np.allclose(own[0].start + own[0].length * own[0].axis, [1.4, 0, 3.45])
    assert stems.hang(two[:1], STEM, True) == (None, [], False)  # a lone one without children goes
    k, own, _ = stems.hang(two[:1], STEM, False)
    assert k == 5 and len(own) == 1
    k, own, added = stems.hang([cyl([0.5, 0.5, 1.2], [0, 1, 0], 1, 0.03)], STEM)  # passes by: a cylinder over the gap
    assert added and k == 2 and len(own) == 2 and np.hypot(*own[0].start[:2]) == pytest.approx(0.1)
    assert np.allclose(own[0].start + own[0].length * own[0].axis, [0.5, 0.5, 1.2]) and own[0].radius == 0.03


def test_lines():
    d, h = stems.between_lines(np.array([5.0, 2, 3]), np.array([1.0, 0, 0]), STEM[0])
    assert (d, h) == pytest.approx((2, 3))
    assert stems.between_lines(np.array([3.0, 4, 7]), np.array([0, 0, 1.0]), STEM[0]) == pytest.approx((5, 7))


def test_clouds_side_by_side():
    """Clouds triangulated side by side are those that each gives alone, holes and flat or tiny clouds included, in fewer calls."""
    rng = np.random.default_rng(11)
    for k in (2, 3):
        clouds = [rng.random((n, k)) * (1 + n % 3) for n in (60, 3, 150, 0, 60, 1, 90)] + [np.repeat(rng.random((20, k)), 2, axis=0)]
        alphas = [0.3, 1.0, 0.2, 1.0, 0.5, 1.0, 0.25, 5.0]
        for fill in (False, True):
            alone = [hulls.alpha_sizes([p], [a], fill)[0] for p, a in zip(clouds, alphas, strict=True)]
            assert np.allclose(hulls.alpha_sizes(clouds, alphas, fill), alone, rtol=1e-9) and min(alone[0], alone[2]) > 0 == alone[3] == alone[5]
        s, _ = hulls.delaunay(clouds[2])
        assert hulls.sizes(hulls.unique_rows(clouds[2]), s).sum() == pytest.approx(hulls.polygon_area(clouds[2][hulls.hull_2d(clouds[2])]) if k == 2 else hulls.hull_3d_volume(clouds[2]), rel=1e-3)
    shell = rng.normal(size=(900, 3))
    shell *= rng.uniform(0.75, 1, (900, 1)) / np.linalg.norm(shell, axis=1)[:, None]
    hollow = hulls.alpha_size(shell, 0.25)
    assert hollow < 0.75 * hulls.hull_3d_volume(shell) < 0.9 * hulls.alpha_size(shell, 0.25, fill=True)


def test_crowns_move_points_once(spark):
    from __spark_entry__ import queries

    plan = queries()["l7_crowns"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    found = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(found) == 1 and "l_suppkey" in found[0] and "FlatMapGroups" not in plan, plan


def test_hull_of_many_corners_in_bounded_memory():
    """Memory goes with the points of a tree, not with points times facets of its hull, and the volume is that of all facets."""
    import tracemalloc

    p = np.random.default_rng(12).normal(size=(4000, 3))
    p /= np.linalg.norm(p, axis=1)[:, None]
    tracemalloc.start()
    v = hulls.hull_3d_volume(p)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 0.99 * 4 / 3 * np.pi < v < 4 / 3 * np.pi and peak < 20e6, (v, peak)
    from itertools import product

    grid = np.array([*product(np.arange(7.0), repeat=3)])
    assert hulls.hull_3d_volume(grid) == pytest.approx(216) and hulls.alpha_size(grid, 0.9) == pytest.approx(216)
    assert hulls.alpha_size(grid[:49, 1:], 0.8) == pytest.approx(36)
