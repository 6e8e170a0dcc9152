"""Filters of page images against their definitions, and boxes led back to the scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.operators import imaging


def page(h=420, w=640, lines=(60, 120, 180, 240, 300, 360)):
    out = np.full((h, w), 235.0)
    for y in lines:
        out[y : y + 14, 70 : w - 70] = 30
    return out


@pytest.mark.parametrize("angle", [-7.3, -3.0, -0.6, 0.0, 0.4, 2.2, 5.5, 7.9])
def test_skew_of_known_angles(angle):
    tilted = imaging.turned(page(), np.linalg.inv(imaging.rotation((420, 640), angle)) if angle else np.eye(3))
    assert abs(imaging.skew(tilted) - angle) <= 0.1 + 1e-9
    straight = imaging.deskewed(tilted, imaging.skew(tilted))
    assert abs(imaging.skew(straight)) <= 0.2


def test_pages_without_lines_do_not_lean():
    rng = np.random.default_rng(1)
    assert imaging.skew(np.full((50, 50), 255.0)) == 0.0 and imaging.skew(np.zeros((3, 200))) == 0.0
    assert imaging.skew(imaging.turned(page(), np.linalg.inv(np.array([[0, 1, 100], [-1, 0, 500], [0, 0, 1]])))) == 0.0  # upright lines
    assert abs(imaging.skew(rng.integers(0, 256, (60, 60)).astype(float))) <= 8


def test_edges_are_ridges_joined_to_strong_ones():
    a = np.zeros((20, 30))
    a[:, 15:] = 100  # strong
    a[10:, :8] += np.linspace(0, 7, 8)  # too faint
    found = imaging.edges(a)
    assert found[:, 14:16].any(1).all() and found.sum() == 20
    a = np.zeros((40, 30))
    a[:, 15:] = np.linspace(10, 60, 40)[:, None]  # weak at the top, strong below, and connected
    b = a.copy()
    b[10:14] = 0  # not connected any more
    assert imaging.edges(a)[6:36, 13:17].any(1).all() and not imaging.edges(b)[3:9, 13:17].any()


def test_components_touch_by_corners():
    rng = np.random.default_rng(2)
    for shape, share in (((30, 40), 0.4), ((1, 50), 0.6), ((50, 1), 0.6), ((25, 25), 0.55), ((9, 9), 0.0)):
        mask = rng.random(shape) < share
        found = imaging.components(mask)
        assert ((found > 0) == mask).all()
        seen = np.zeros(shape, np.int64)
        for start in zip(*np.nonzero(mask), strict=True):
            if seen[start]:
                continue
            stack, n = [start], found[start]
            while stack:
                y, x = stack.pop()
                if not (0 <= y < shape[0] and 0 <= x < shape[1]) or not mask[y, x] or seen[y, x]:
                    continue
                seen[y, x] = n
                stack += [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        assert (seen == found).all()  # no component in two parts, nor two with one number
        assert len(np.unique(found[mask])) == len({n for n in seen[mask].tolist()})


def test_turning_keeps_straight_pages_and_cubic_curves():
    a = page()
    assert imaging.turned(a, np.eye(3)) is a and np.array_equal(imaging.rotation(a.shape, 0.1), np.eye(3)) and np.array_equal(imaging.rotation(a.shape, 8.5), np.eye(3))
    moved = imaging.turned(a, np.array([[1, 0, 3.0], [0, 1, 2.0], [0, 0, 1]]))
    assert np.allclose(moved[2:, 3:], a[:-2, :-3]) and (moved[:2] == 255).all() and (moved[:, :3] == 255).all()
    assert all(np.allclose(sum(imaging._cubic(np.array([p]))), 1) for p in (0.0, 0.3, 0.99))
    there = imaging.turned(a, imaging.rotation(a.shape, 2.0))
    assert np.abs(imaging.turned(there, np.linalg.inv(imaging.rotation(a.shape, 2.0)))[60:-60, 60:-60] - a[60:-60, 60:-60]).mean() < 4


def test_median_and_non_local_means_by_their_definition():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, (17, 23)).astype(float)
    p = np.pad(a, 2, mode="edge")
    assert np.array_equal(imaging.median(a, 5), [[np.median(p[y : y + 5, x : x + 5]) for x in range(23)] for y in range(17)])
    smooth = np.tile(np.linspace(50, 200, 300), (200, 1))
    assert np.abs(imaging.median(smooth, 65)[40:-40, 40:-40] - smooth[40:-40, 40:-40]).max() < 3  # thinned
    a = np.clip(rng.normal(100, 5, (14, 16)).round() + 60 * (np.arange(16) > 8), 0, 255)
    patch, search = 3, 7
    p = np.pad(a, 4, mode="reflect")
    want = np.zeros(a.shape)
    for y in range(14):
        for x in range(16):
            part = lambda v, u: p[v + 4 - 1 : v + 4 + 2, u + 4 - 1 : u + 4 + 2]
            total = weight = 0.0
            for i in range(-3, 4):
                for j in range(-3, 4):
                    w = np.exp(-((part(y, x) - part(y + i, x + j)) ** 2).mean() / 16)
                    total, weight = total + w * p[y + i + 4, x + j + 4], weight + w
            want[y, x] = round(total / weight)
    assert np.array_equal(imaging.denoised(a, 4.0, patch, search), want)
    assert np.abs(imaging.denoised(a) - 100 - 60 * (np.arange(16) > 8)).mean() < np.abs(a - 100 - 60 * (np.arange(16) > 8)).mean()


def test_equalisation_by_tiles_by_its_definition(monkeypatch):
    rng = np.random.default_rng(4)
    for h, w in ((32, 48), (35, 50)):
        a = rng.integers(60, 120, (h, w)).astype(float)
        tiles, limit = 4, 3.0
        high, wide = -(-h // tiles), -(-w // tiles)
        p = np.pad(a, ((0, high * tiles - h), (0, wide * tiles - w)), mode="reflect").astype(int)
        curves = {}
        for j in range(tiles):
            for i in range(tiles):
                count = [0] * 256
                for v in p[j * high : (j + 1) * high, i * wide : (i + 1) * wide].reshape(-1).tolist():
                    count[v] += 1
                most = max(int(limit * high * wide / 256), 1)
                over = sum(max(c - most, 0) for c in count)
                count = [min(c, most) + over // 256 for c in count]
                step, at, rest = max(256 // (over % 256), 1) if over % 256 else 1, 0, over % 256
                while rest and at < 256:
                    count[at] += 1
                    at, rest = at + step, rest - 1
                curves[j, i] = [round(sum(count[: v + 1]) * 255 / (high * wide)) for v in range(256)]
        found = imaging.equalized(a, limit, tiles)
        for y, x in [(0, 0), (h - 1, w - 1), (h // 2, w // 3), (high, wide), (3, w - 1)]:
            v, u = y / high - 0.5, x / wide - 0.5
            j, i = int(np.floor(v)), int(np.floor(u))
            q, r = v - j, u - i
            get = lambda j, i: curves[min(max(j, 0), tiles - 1), min(max(i, 0), tiles - 1)][int(a[y, x])]  # noqa: B023, E731
            want = (get(j, i) * (1 - r) + get(j, i + 1) * r) * (1 - q) + (get(j + 1, i) * (1 - r) + get(j + 1, i + 1) * r) * q
            assert abs(found[y, x] - want) <= 0.5 + 1e-9
    assert np.ptp(imaging.equalized(a)) > np.ptp(a)


def test_variants_of_a_tilted_page_share_its_straightened_frame(spark):
    tilted = imaging.turned(page(), np.linalg.inv(imaging.rotation((420, 640), 3.0)))
    found, matrix = imaging.straight_variants(tilted)
    assert list(found) == list(imaging.VARIANTS) and all(v.shape == (420, 640) for v in found.values())
    assert set(np.unique(found["binarisiert"])) <= {0.0, 255.0}
    assert np.allclose(matrix, imaging.rotation((420, 640), 3.0), atol=1.0)
    want = imaging.line_boxes(page())
    for name in ("original", "binarisiert"):
        boxes = imaging.line_boxes(found[name])
        assert len(boxes) == len(want) == 6 and np.abs(np.array(boxes) - want).max() <= 2
    back = np.linalg.inv(imaging.rotation((420, 640), 3.0))
    rows = spark.createDataFrame([(k, dict(zip(("x1", "y1", "x2", "y2"), b, strict=True)), matrix.reshape(-1).tolist()) for k, b in enumerate(want)], "k int, b struct<x1:int,y1:int,x2:int,y2:int>, m array<double>")
    for r in rows.select("k", imaging.box_back(F.col("b"), F.col("m")).alias("b")).collect():
        x1, y1, x2, y2 = want[r.k]
        corners = (back @ np.array([[x1, x2, x1, x2], [y1, y1, y2, y2], [1, 1, 1, 1]]))[:2]
        assert np.abs(np.array(r.b) - np.concatenate((corners.min(1), corners.max(1)))).max() <= 1.0
    same = spark.createDataFrame([(dict(x1=1, y1=2, x2=3, y2=4), np.eye(3).reshape(-1).tolist()), (dict(x1=1, y1=2, x2=3, y2=4), None)], "b struct<x1:int,y1:int,x2:int,y2:int>, m array<double>")
    assert [tuple(r[0]) for r in same.select(imaging.box_back(F.col("b"), F.col("m"))).collect()] == [(1, 2, 3, 4)] * 2
