"""Smoothing against sweeps point by point."""

import random

import pytest

from tracewright.operators import joins as J
from tracewright.operators import sequences as S

PATHS = "path_id long, seq int, x double, y double"
RINGS = "area_id long, ring int, pos int, x double, y double"


def plain(points, meets=None, w_data=0.5, w_smooth=0.3, tol=1e-3):
    now, free, change = [list(p) for p in points], [tuple(p) for p in points], tol
    while change >= tol:
        change = 0.0
        for i in range(1, len(points) - 1):
            for j in (0, 1):
                was = now[i][j]
                now[i][j] += w_data * (points[i][j] - was) + w_smooth * (now[i - 1][j] + now[i + 1][j] - 2 * was)
                change += abs(now[i][j] - was)
        if meets is not None:
            if meets(now):
                return free
            free = [tuple(p) for p in now]
    return [tuple(p) for p in now]


def table(spark, paths):
    return spark.createDataFrame([(k, i, None if p is None else float(p[0]), None if p is None else float(p[1])) for k, ps in paths.items() for i, p in enumerate(ps)], PATHS)


def lists(df):
    out = {}
    for r in df.orderBy("path_id", "seq").collect():
        out.setdefault(r.path_id, []).append((r.x, r.y))
    return out


def near(got, want, by):
    return len(got) == len(want) and all(abs(a - c) <= by and abs(b - d) <= by for (a, b), (c, d) in zip(got, want, strict=True))


def walk(r, n):
    x, y, out = 4.5e5, 5.6e6, []
    for _ in range(n):
        out.append((x, y))
        x, y = x + r.uniform(-5, 20), y + r.uniform(-9, 9)
    return out


@pytest.mark.parametrize("w_data, w_smooth, by", [(0.5, 0.3, 1e-3), (0.1, 0.45, 1e-2), (1.2, 0.05, 1e-3), (0.3, 0.0, 1e-3), (0.02, 0.9, 1e-2)])
def test_where_sweeps_end(spark, w_data, w_smooth, by):
    r = random.Random(int(100 * w_data))
    paths = {k: walk(r, n) for k, n in enumerate([1, 2, 3, 4, 5, 9, 30, 200, 1500])}
    paths[100] = [(1, 1)] * 6
    got = lists(S.smooth_paths(table(spark, paths).repartition(5), w_data=w_data, w_smooth=w_smooth))
    assert set(got) == set(paths)
    for k, p in paths.items():
        assert near(got[k], plain(p, None, w_data, w_smooth, 1e-4 if w_smooth > 0.4 else 1e-3), by), k
        assert got[k][0] == p[0] and got[k][-1] == p[-1]


def test_points_that_nothing_holds_end_on_the_chord(spark):
    got = lists(S.smooth_paths(table(spark, {1: [(0, 0), (7, 3), (1, 9), (9, 6)]}), w_data=0.0))
    assert near(got[1], [(0, 0), (3, 2), (6, 4), (9, 6)], 1e-9)
    assert lists(S.smooth_paths(table(spark, {1: [(0, 0), (7, 3), (1, 9)]}), w_data=0.0, w_smooth=0.0))[1][1] == (7, 3)


def test_points_that_are_no_numbers_are_ends(spark):
    one, two = [(0, 0), (1, 4), (2, 0)], [(5, 5), (6, 0), (7, 5), (8, 0)]
    got = lists(S.smooth_paths(table(spark, {1: [*one, None, *two], 2: [(0, 0), (float("nan"), 1), (3, 3)], 3: [None]})))
    assert near(got[1][:3], plain(one), 1e-3) and got[1][3] == (None, None) and near(got[1][4:], plain(two), 1e-3)
    assert got[2][0] == (0, 0) and got[2][1][0] != got[2][1][0] and got[2][1][1] == 1 and got[2][2] == (3, 3) and got[3] == [(None, None)]
    empty = table(spark, {1: one}).filter("false")
    assert S.smooth_paths(empty).count() == 0 and S.smooth_paths(empty, spark.createDataFrame([], RINGS)).count() == 0


def test_weights_with_which_sweeps_do_not_settle(spark):
    for weights in ((-0.1, 0.3), (0.5, -0.1), (1.0, 0.5)):
        with pytest.raises(ValueError):
            S.smooth_paths(table(spark, {1: [(0, 0)]}), w_data=weights[0], w_smooth=weights[1])


def boxes_rings(boxes):
    return [(a, 0, i, float(x), float(y)) for a, (x, y, s) in boxes.items() for i, (x, y) in enumerate([(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)])]


def meets_boxes(boxes, inflate):
    """By steps of a thousandth of a leg: whether a point lies within inflate of a box."""

    def meets(points):
        for (ax, ay), (bx, by) in zip(points, points[1:], strict=False):
            for x, y, s in boxes.values():
                if min(ax, bx) > x + s + inflate or max(ax, bx) < x - inflate or min(ay, by) > y + s + inflate or max(ay, by) < y - inflate:
                    continue
                for k in range(1001):
                    px, py = ax + (bx - ax) * k / 1000, ay + (by - ay) * k / 1000
                    dx, dy = max(x - px, 0, px - x - s), max(y - py, 0, py - y - s)
                    if dx * dx + dy * dy <= inflate * inflate:
                        return True
        return False

    return meets


def test_a_path_that_meets_an_obstacle_keeps_its_last_free_state(spark):
    r, w_data, w_smooth = random.Random(7), 0.5, 0.3
    boxes = {k: (r.uniform(0, 400), r.uniform(-30, 30), r.uniform(1, 6)) for k in range(25)}
    meets, paths = meets_boxes(boxes, 0.25), {}
    while len(paths) < 24:
        x, p = r.uniform(-200, 300), []
        for _ in range(r.randint(3, 9)):
            p.append((x, r.uniform(-30, 30)))
            x += r.uniform(5, 20)
        if not meets(p):
            paths[len(paths)] = p
    want = {k: plain(p, meets, w_data, w_smooth) for k, p in paths.items()}
    held = sum(want[k] == p for k, p in paths.items())
    settled = sum(near(want[k], plain(p, None, w_data, w_smooth), 1e-9) for k, p in paths.items())
    assert held and settled and held + settled < len(paths)  # all three ends occur: at once, never, and midway
    got = lists(S.smooth_paths(table(spark, paths), spark.createDataFrame(boxes_rings(boxes), RINGS), w_data, w_smooth))
    assert set(got) == set(paths)
    for k in paths:
        assert near(got[k], want[k], 2e-3), k


def test_paths_near_leaves_out_none(spark):
    rings = spark.createDataFrame(boxes_rings({1: (0, 0, 10), 2: (1000, 0, 300)}), RINGS)
    rows = [(1, -3.0, 5.0, -2.0, 5.0, 2.5), (2, -3.0, 5.0, -2.0, 5.0, 1.5), (3, 1100.0, 100.0, 1101.0, 100.0, 0.0), (4, 500.0, 0.0, 501.0, 0.0, 600.0), (5, 500.0, 0.0, 501.0, 0.0, 100.0)]
    legs = spark.createDataFrame([(p, 0, *rest) for p, *rest in rows], "path_id long, leg int, x1 double, y1 double, x2 double, y2 double, within double")
    assert {x.path_id for x in J.paths_near(legs, rings).collect()} == {1, 3, 4}


def test_weights_with_which_all_paths_are_swept(spark):
    """A sweep may carry points past where they end, so that no bound says which paths stay free."""
    paths, boxes = {1: [(0, 0), (4, 3), (8, 0), (12, 3)], 2: [(0, 9), (4, 9)]}, {1: (500, 500, 5)}
    got = lists(S.smooth_paths(table(spark, paths), spark.createDataFrame(boxes_rings(boxes), RINGS), 0.9, 0.3, tol=0.5))
    assert set(got) == {1, 2} and all(near(got[k], plain(p, None, 0.9, 0.3, 0.5), 1e-9) for k, p in paths.items())
