"""Operators on tiles that cross their borders: components, distances, maps, edges, lines, deskewing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartwave.operators import regions, strokes, tiles, warps
from chartwave.plans import deskew

IMAGES = "image_id string, width int, height int, px binary"


def tiled(spark, images, size=16):
    rows = [(i, a.shape[1], a.shape[0], a.astype(np.uint8).tobytes()) for i, a in images.items()]
    return tiles.from_images(spark.createDataFrame(rows, IMAGES), size)


def whole(made):
    out = {}
    for r in made.collect():
        grid = out.setdefault(r.image_id, np.zeros((r.height, r.width), dtype=np.uint8))
        grid[r.y0 : r.y0 + r.h, r.x0 : r.x0 + r.w] = np.frombuffer(r.px, dtype=np.uint8).reshape(r.h, r.w)
    return out


def flood(on):
    """Component of each pixel, named by its first pixel's place; -1 outside."""
    label = np.full(on.shape, -1)
    for y, x in zip(*np.nonzero(on)):
        if label[y, x] < 0:
            open_ = [(y, x)]
            label[y, x] = y * on.shape[1] + x
            while open_:
                a, b = open_.pop()
                for v in range(max(0, a - 1), min(on.shape[0], a + 2)):
                    for u in range(max(0, b - 1), min(on.shape[1], b + 2)):
                        if on[v, u] and label[v, u] < 0:
                            label[v, u] = y * on.shape[1] + x
                            open_.append((v, u))
    return label


@pytest.fixture(scope="module")
def masks():
    rng = np.random.default_rng(7)
    made = {f"n{k}": (rng.random((rng.integers(1, 60), rng.integers(1, 60))) < p) * 255 for k, p in enumerate((0.1, 0.3, 0.4, 0.5, 0.7))}
    snake = np.zeros((50, 40))
    snake[::4] = 255
    for k in range(12):
        snake[4 * k : 4 * k + 4, 39 if k % 2 else 0] = 255
    return made | {"snake": snake, "empty": np.zeros((20, 33)), "full": np.full((33, 17), 255), "one": np.full((1, 1), 255)}


@pytest.mark.parametrize("links", [1 << 20, 0])
def test_components_over_tile_borders(spark, masks, monkeypatch, links):
    monkeypatch.setattr(regions, "LINKS", links)
    made = tiled(spark, masks, 16 if links else 8)
    got, parts = regions.regions(made)
    wanted = set()
    for i, a in masks.items():
        label = flood(a > 0)
        for k in np.unique(label[label >= 0]):
            y, x = np.nonzero(label == k)
            wanted.add((i, int(k), len(y), y.min(), x.min(), y.max(), x.max()))
    assert {tuple(r) for r in got.collect()} == wanted
    assert parts.groupBy().agg(F.sum("area")).first()[0] == sum((a > 0).sum() for a in masks.values())


def test_small_components_go(spark, masks):
    got = whole(regions.without_small(tiled(spark, masks), 5))
    for i, a in masks.items():
        label = flood(a > 0)
        sizes = np.bincount(label[label >= 0], minlength=label.size)
        assert ((label >= 0) & (sizes[label] >= 5)).tolist() == (got[i] == 255).tolist()


@pytest.mark.parametrize("area", [1 << 20, 100])
def test_exact_distances(spark, masks, monkeypatch, area):
    monkeypatch.setattr(regions, "AREA", area)
    got = {}
    for r in regions.squared_distances(tiled(spark, masks)).collect():
        got.setdefault(r.image_id, np.zeros((r.height, r.width), dtype=np.int64))[r.y0 : r.y0 + r.h] = np.frombuffer(r.d2, dtype=np.int64).reshape(r.h, r.width)
    for i, a in masks.items():
        y, x = np.nonzero(a)
        v, u = np.indices(a.shape)
        if len(y):
            assert (got[i] == ((v[..., None] - y) ** 2 + (u[..., None] - x) ** 2).min(axis=-1)).all()
        else:
            assert (got[i] >= regions.NONE).all()


def test_distances_of_a_large_mask(spark):
    a = np.zeros((3000, 4000), dtype=np.uint8)
    spots = np.random.default_rng(1).integers(0, (3000, 4000), (40, 2))
    a[tuple(spots.T)] = 255
    asked = spark.createDataFrame([("a", int(y), int(x)) for y, x in ((0, 0), (2999, 3999), (1500, 2000), (2999, 0))], "image_id string, y int, x int")
    held = spark.createDataFrame([("a", int(y), int(x)) for y, x in spots] + [("b", 1, 1)], "image_id string, y int, x int")
    got = {(r.y, r.x): r.dist for r in regions.distances_at(asked, held).collect()}
    assert got == {p: pytest.approx(min(np.hypot(p[0] - y, p[1] - x) for y, x in spots)) for p in got} and len(got) == 4
    assert regions.distances_at(asked, held.where("image_id = 'b'")).count() == 0


def slow_warp(a, m, w, h, repeat):
    out = np.zeros((h, w))
    for y in range(h):
        for x in range(w):
            q = m[6] * x + m[7] * y + m[8]
            if q == 0:
                continue
            sx, sy = (m[0] * x + m[1] * y + m[2]) / q, (m[3] * x + m[4] * y + m[5]) / q
            v, u = int(np.floor(sy)), int(np.floor(sx))
            value = 0.0
            for dy in (0, 1):
                for dx in (0, 1):
                    inside = 0 <= v + dy < a.shape[0] and 0 <= u + dx < a.shape[1]
                    g = a[min(max(v + dy, 0), a.shape[0] - 1), min(max(u + dx, 0), a.shape[1] - 1)] if repeat or inside else 0
                    value += abs(1 - dy - (sy - v)) * abs(1 - dx - (sx - u)) * g
            out[y, x] = np.floor(round(value, 6) + 0.5)
    return out


@pytest.mark.parametrize("repeat", [True, False])
def test_maps(spark, repeat):
    rng = np.random.default_rng(2)
    images = {"a": rng.integers(0, 256, (37, 50)), "b": rng.integers(0, 256, (9, 70)), "c": np.full((1, 1), 9), "d": rng.integers(0, 256, (33, 20)), "e": rng.integers(0, 256, (20, 20))}
    maps = {"a": ([0.9, 0.2, -3.0, -0.1, 1.1, 4.0, 0.001, -0.002, 1.0], 41, 30), "b": ([1.0, 0, 0, 0, 1, 0, 0, 0, 1], 70, 9), "c": ([0.3, 0, 0, 0, 0.3, 0, 0, 0, 1], 5, 4),
            "d": ([1.0, 0, 3, 0, 1, 2, 0.08, 0, -1.0], 24, 20), "e": ([1.0, 0, 900, 0, 1, -700, 0, 0, 1], 18, 18)}
    rows = [(i, [float(v) for v in m], w, h) for i, (m, w, h) in maps.items()]
    made = warps.warp(tiled(spark, images), spark.createDataFrame(rows, "image_id string, m array<double>, out_w int, out_h int"), repeat, 16)
    got = whole(made)
    for i, (m, w, h) in maps.items():
        assert np.abs(got[i].astype(float) - slow_warp(images[i], m, w, h, repeat)).max() == 0, i


def test_straightened_quads_map_corner_to_corner(spark):
    quad = [(10.0, 12.0), (90.0, 20.0), (84.0, 70.0), (8.0, 60.0)]
    rows = [("a", [{"x": x, "y": y} for x, y in quad])]
    r = warps.straightened(spark.createDataFrame(rows, "image_id string, corners array<struct<x: double, y: double>>")).first()
    assert (r.out_w, r.out_h) == (int(np.hypot(80, 8)), int(np.hypot(6, 50)))
    for (x, y), p in zip([(0, 0), (r.out_w - 1, 0), (r.out_w - 1, r.out_h - 1), (0, r.out_h - 1)], quad):
        sy, sx, _ = warps.spots(np.array(r.m), y, x)
        assert (sx, sy) == pytest.approx(p)


def test_edges_do_not_depend_on_the_tiles(spark):
    rng = np.random.default_rng(4)
    y, x = np.indices((70, 90))
    images = {"a": np.clip((np.hypot(y - 30, x - 40) < 20) * 120 + rng.normal(60, 8, (70, 90)), 0, 255), "b": np.clip(x * 3 + 100 * (y > 35), 0, 255), "c": np.zeros((5, 3))}
    large, small = (whole(strokes.edges(tiled(spark, images, s), 60, 150, s)) for s in (512, 16))
    for i, a in images.items():
        assert (large[i] == small[i]).all()
        padded = np.pad(a.astype(np.uint8), 2, mode="edge")
        inside = np.pad(np.ones(a.shape, dtype=bool), 2)
        weak = strokes.ridges(padded, inside, 60, 150)
        label = flood(weak > 0)
        sure = np.unique(label[weak == 2])
        assert (np.isin(label, sure[sure >= 0]) == (small[i] == 255)).all()
    assert (small["a"] > 0).sum() > 80 and (small["b"][34:37] > 0).any()


def drawn_lines():
    images, lines = {}, {}
    for k, angle in enumerate((-7.0, 0.0, 3.4, 88.0)):
        a = np.zeros((160, 200))
        d = np.deg2rad(angle)
        t = np.arange(-60, 61, 0.25)
        x, y = 100 + t * np.cos(d), 80 + t * np.sin(d)
        a[np.rint(y).astype(int), np.rint(x).astype(int)] = 255
        images[f"l{k}"] = a
        lines[f"l{k}"] = (angle, (x[0], y[0]), (x[-1], y[-1]))
    return images, lines


def test_segments_of_drawn_lines(spark):
    images, lines = drawn_lines()
    got = {}
    for r in strokes.segments(tiled(spark, images, 32), 60, 60, 5).collect():
        if r.votes > got.get(r.image_id, (0,))[0]:
            got[r.image_id] = r.votes, r
    for i, (angle, *ends) in lines.items():
        r = got[i][1]
        found = np.degrees(np.arctan2(r.y2 - r.y1, r.x2 - r.x1))
        assert abs((found - angle + 90) % 180 - 90) < 0.5
        for x, y in ends:
            assert min(np.hypot(x - r.x1, y - r.y1), np.hypot(x - r.x2, y - r.y2)) < 1.5


def chart(height=300, width=420, marks=True, paper=True, step=20):
    """A sheet with a grid, in colour: dark table around it if paper, red marks in its corners if marks."""
    a = np.full((height, width, 3), 235, dtype=np.uint8)
    a[::step, :], a[:, ::step] = (170, 175, 235), (170, 175, 235)
    a[1::step, :], a[:, 1::step] = (170, 175, 235), (170, 175, 235)
    if marks:
        for y in (14, height - 26):
            for x in (14, width - 26):
                a[y : y + 12, x : x + 12] = (20, 20, 220)
    return np.pad(a, ((60, 60), (60, 60), (0, 0)), constant_values=30) if paper else a


def moved(a, m):
    """The picture seen through the inverse of an output-to-input map, nearest pixel."""
    h, w = a.shape[:2]
    y, x = np.indices((h, w))
    sy, sx, _ = warps.spots(np.array(m), y, x)
    v, u = np.clip(np.rint(sy).astype(int), 0, h - 1), np.clip(np.rint(sx).astype(int), 0, w - 1)
    return a[v, u]


def rotation(a, angle):
    h, w = a.shape[:2]
    c, s = np.cos(np.deg2rad(angle)), np.sin(np.deg2rad(angle))
    cx, cy = w // 2, h // 2
    return [c, s, cx - c * cx - s * cy, -s, c, cy + s * cx - c * cy, 0, 0, 1]


def grid_angle(spark, made):
    return {r.image_id: r.angle for r in deskew.tilt(made, 128).collect()}


def test_deskew(spark):
    marked, bare = chart(), chart(marks=False)
    open_ = np.where(chart(marks=False, paper=False) == 235, 165, 90)  # too dark for paper
    pictures = {"marks": moved(marked, rotation(marked, 6)), "seen": moved(marked, [1.02, 0.05, -12, 0.03, 1.01, -8, 0.0001, 0.00005, 1]), "sheet": moved(bare, rotation(bare, -5)), "fine": moved(open_, rotation(open_, 3)), "level": open_}
    rows = [(i, a.shape[1], a.shape[0], a.astype(np.uint8).tobytes()) for i, a in pictures.items()]
    made = deskew.colour_tiles(spark.createDataFrame(rows, IMAGES), 128)
    done, report = deskew.deskew(made, 128)
    method = {r.image_id: r.method for r in report.collect()}
    assert method["marks"].startswith("red_corners") and method["seen"].startswith("red_corners") and method["sheet"].startswith("paper_boundary")
    assert method["fine"] == "fine_rotation" and method["level"] == "none"
    left = grid_angle(spark, done)
    assert set(left) == set(pictures) and all(abs(a) < 0.3 for a in left.values()), left


def test_morphology_in_one_exchange(spark, masks):
    """each opening and closing cost two exchanges and a pass for each pixel of its square; sides may be even."""
    def ranked(a, n, pick):
        up = n // 2 if pick is np.fmin else n - 1 - n // 2
        b = np.pad(np.asarray(a, dtype=float), ((up, n - 1 - up),) * 2, constant_values=np.nan)
        views = np.lib.stride_tricks.sliding_window_view(b, (n, n))
        return pick.reduce(views.reshape(*a.shape, -1), axis=2)

    rng = np.random.default_rng(3)
    images = masks | {"gray": rng.integers(0, 256, (33, 50))}
    got = whole(tiles.smoothed(tiled(spark, images, 16), 6, 3, 16))
    for i, a in images.items():
        assert (got[i] == ranked(ranked(ranked(ranked(a, 6, np.fmax), 6, np.fmin), 3, np.fmin), 3, np.fmax)).all(), i


def test_tiles_put_together(spark):
    """many small tiles of an image become one; planes stay, tiles need not fit into each other."""
    a = np.random.default_rng(5).integers(0, 256, (70, 90, 3)).astype(np.uint8)
    made = deskew.colour_tiles(spark.createDataFrame([("a", 90, 70, a.tobytes())], IMAGES), 16)
    for size in (128, 40, 7):
        back = tiles.retiled(made, size).collect()
        again = {(r.y0, r.x0): r.px for r in tiles.cut(tiles.retiled(made, 40), 8).collect()}
        assert again == {(r.y0, r.x0): r.px for r in tiles.cut(made, 8).collect()} and len(again) == 9 * 12
        assert len(back) == -(-70 // size) * -(-90 // size)
        for r in back:
            assert (np.frombuffer(r.px, dtype=np.uint8).reshape(r.h, r.w, 3) == a[r.y0 : r.y0 + r.h, r.x0 : r.x0 + r.w]).all() and (r.width, r.height) == (90, 70)


def test_whole_images_and_tiles_give_the_same(spark, monkeypatch):
    """edges, hulls, segments and the whole deskewing of images in one tile are those of images in several."""
    marked, bare = chart(), chart(marks=False)
    pictures = {"marks": moved(marked, rotation(marked, 6)), "sheet": moved(bare, rotation(bare, -5)), "level": bare}
    rows = [(i, a.shape[1], a.shape[0], a.astype(np.uint8).tobytes()) for i, a in pictures.items()]
    made = deskew.colour_tiles(spark.createDataFrame(rows, IMAGES), 128)
    found = {}
    for work in (64, 512):
        monkeypatch.setattr(deskew, "WORK", work)
        done, report = deskew.deskew(made, 64)
        assert max(max(r.h, r.w) for r in done.collect()) == 64
        gray = tiles.retiled(deskew.mapped(made, deskew.gray), work)
        mask = strokes.edges(gray, 30, 120, work)
        runs = strokes.segments(mask, 80, 80, 15)
        near = strokes.segments(mask, 80, 80, 15, 20.0)
        lines = lambda f: sorted((r.image_id, r.theta, r.rho, r.votes, *(round(v, 6) for v in (r.x1, r.y1, r.x2, r.y2))) for r in f.collect())
        hulls = sorted((r.image_id, r.label, r.area, r.hull) for r in strokes.hulls(mask).collect())
        found[work] = whole(mask), hulls, lines(runs), lines(near), {r.image_id: (r.method, round(r.angle, 6)) for r in report.collect()}
        assert found[work][3] == [r for r in found[work][2] if abs(r[1] - 90) <= 20] and found[work][3]
    assert all((found[64][0][i] == found[512][0][i]).all() for i in pictures) and found[64][1:] == found[512][1:]


def test_contrast_and_size(spark):
    rng = np.random.default_rng(6)
    a = rng.integers(0, 256, (20, 30, 3)).astype(np.uint8)
    made = deskew.colour_tiles(spark.createDataFrame([("a", 30, 20, a.tobytes())], IMAGES), 8)
    done = deskew.process_image(made, 2.0, 0.5, 16)
    assert {(r.width, r.height) for r in done.collect()} == {(60, 40)}
    one = next(np.frombuffer(r.px, dtype=np.uint8).reshape(-1, 3) for r in deskew.contrast(made).collect() if (r.y0, r.x0) == (0, 0))
    v = a.max(axis=2)
    share = np.cumsum(np.bincount(v.ravel(), minlength=256)) / v.size
    curve = np.floor(np.round(255 * (np.arange(256) / 255) ** np.clip(1 - share**0.5, 0.01, 10), 6))
    assert (one.max(axis=1) == curve[v[:8, :8].ravel()]).all()


def test_colours_there_and_back():
    every = np.stack(np.meshgrid(*[np.arange(0, 256, 15)] * 3), axis=-1).reshape(-1, 3)
    back = deskew.bgr_of(*deskew.hsv_of(every))
    assert np.abs(back - every).max() <= 6


def test_baseline_rows(spark):
    def drawn(rows, height=240, width=100):
        a = np.zeros((height, width))
        for y, n in rows:
            a[y, :n] = 255
        return a

    images = {"four": drawn([(30, 90), (90, 80), (150, 85), (210, 70)]), "close": drawn([(30, 90), (62, 60), (94, 70), (130, 50), (200, 40)]), "two": drawn([(50, 90), (180, 80)]), "none": drawn([]), "weak": drawn([(30, 90), (90, 80), (150, 85), (210, 11)])}
    got = {r.image_id: r.baselines for r in deskew.baseline_rows(tiled(spark, images, 64)).collect()}
    assert got == {"four": [30, 90, 150, 210], "close": [30, 62, 94, 130], "two": [50, 180], "none": [], "weak": [30, 90, 150, 210]}


def test_skeleton_does_not_depend_on_the_tiles(spark):
    from chartwave.operators.edges import thinned

    rng = np.random.default_rng(8)
    thick = np.zeros((70, 90))
    for y, x in zip(rng.integers(5, 65, 14), rng.integers(5, 85, 14)):
        thick[max(0, y - rng.integers(2, 12)) : y + 8, max(0, x - 3) : x + rng.integers(2, 30)] = 255
    images = {"a": thick, "b": np.full((40, 25), 255), "none": np.zeros((9, 9))}
    for rounds in (8, 2):
        got = whole(strokes.skeleton(tiled(spark, images, 16), 16, rounds))
        for i, a in images.items():
            assert (got[i] == 255 * thinned(a > 0)).all(), i


def test_outlines_enclose_their_pixels(spark, masks):
    from chartwave.operators import contours

    ring = np.zeros((40, 50))
    ring[5:35, 6:45] = 255
    ring[10:20, 12:30] = 0
    ring[12:15, 15:18] = 255
    ring[25, 40] = 0
    images = masks | {"ring": ring}
    found = {}
    for r in contours.polygons(contours.outlines(tiled(spark, images), 16)).collect():
        found.setdefault((r.image_id, r.label), []).append(r)
    for i, a in images.items():
        label = flood(a > 0)
        for k in np.unique(label[label >= 0]):
            rings = sorted(found.pop((i, int(k))), key=lambda r: r.ring)
            assert sum(-r.area if r.hole else r.area for r in rings) == (label == k).sum()
            assert [r.hole for r in rings] == [False] + [True] * (len(rings) - 1)
            # Holes are the 4-neighbour parts of the outside that the component encloses.
            grid = np.pad(label != k, 1, constant_values=True)
            parts, seen = 0, np.zeros(grid.shape, dtype=bool)
            for y, x in zip(*np.nonzero(grid)):
                if not seen[y, x]:
                    parts += 1
                    open_ = [(y, x)]
                    seen[y, x] = True
                    while open_:
                        p, q = open_.pop()
                        for v, u in ((p - 1, q), (p + 1, q), (p, q - 1), (p, q + 1)):
                            if 0 <= v < grid.shape[0] and 0 <= u < grid.shape[1] and grid[v, u] and not seen[v, u]:
                                seen[v, u] = True
                                open_.append((v, u))
            assert len(rings) == parts, (i, k)
            edges = sum((np.diff(np.pad(label == k, 1).astype(int), axis=ax) != 0).sum() for ax in (0, 1))
            assert sum(r.length for r in rings) == edges
            if (i, k) == ("ring", 5 * 50 + 6):
                assert [len(r.polygon) for r in rings] == [4, 4, 4] and rings[0].corners == [[6, 5], [45, 5], [45, 35], [6, 35]]
    assert not found


def test_local_contrast_equals_the_pixel_form(spark):
    from chartwave.operators import contrast, edges

    rng = np.random.default_rng(10)
    images = {"a": rng.integers(0, 256, (37, 50)), "b": np.clip(rng.normal(90, 10, (20, 33)), 0, 255).astype(int), "c": np.indices((64, 48)).sum(axis=0)}
    got = whole(contrast.local_contrast(tiled(spark, images), 2.0, 4))
    for i, a in images.items():
        rows = [(i, y, x, int(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])]
        pixels = spark.createDataFrame(rows, "image_id string, y int, x int, gray int")
        wanted = np.zeros(a.shape)
        for r in edges.local_contrast(pixels, a.shape[1], a.shape[0], 2.0, 4).collect():
            wanted[r.y, r.x] = r.gray
        assert np.abs(got[i] - wanted).max() == 0, i
