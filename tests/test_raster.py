"""Raster operators against brute force and drawn pages."""

import duckdb
import numpy as np
import pytest

from quiresmith.operators import profile, raster
from quiresmith.plans import queries as Q

WHERE = "/root/testdata/sf0.001"


def opening(mask, length):
    """Erosion, then dilation, by a flat line; beyond the edge counts as ink in the first and as paper in the second."""
    w, a = mask.shape[1], length // 2
    out = np.zeros_like(mask)
    for r, row in enumerate(mask):
        for x in range(w):
            if all(row[k] for k in range(max(0, x - a), min(w, x - a + length))):
                out[r, max(0, x - a) : x - a + length] = True
    return out & mask


@pytest.mark.parametrize("length", [1, 4, 5, 9])
def test_long_runs_are_an_opening(length):
    mask = np.random.default_rng(length).random((60, 40)) < 0.8
    assert (raster.long_runs(mask, length) == opening(mask, length)).all()
    assert not raster.long_runs(np.zeros((3, 5), bool), length).any() and raster.long_runs(np.ones((3, 50), bool), length).all()


def test_otsu_is_the_best_level():
    gray = np.random.default_rng(1).choice([3, 50, 51, 200, 220], (20, 30), p=[0.1, 0.2, 0.1, 0.4, 0.2]).astype(np.uint8)

    def spread(t):
        low, high = gray[gray <= t].astype(float), gray[gray > t].astype(float)
        return round(len(low) * len(high) * (low.mean() - high.mean()) ** 2, 3) if len(low) and len(high) else -1

    best = max(map(spread, range(256)))
    assert raster.otsu(gray) == min(t for t in range(256) if spread(t) == best)
    assert raster.otsu(np.full((4, 4), 9, np.uint8)) == 0


def page(degrees=0.0, w=420, h=300):
    """Bars of text, turned about the middle."""
    y, x = np.mgrid[:h, :w]
    t = np.radians(degrees)
    u, v = (x - w / 2) * np.cos(t) + (y - h / 2) * np.sin(t), -(x - w / 2) * np.sin(t) + (y - h / 2) * np.cos(t)
    return np.where((abs(u) < 150) & (abs(v) < 90) & (np.floor(v / 8) % 2 == 0), 10, 240).astype(np.uint8)


@pytest.mark.parametrize("degrees", [-7.0, -1.5, 0.6, 4.0])
def test_skew_is_found_and_levelled(degrees):
    assert abs(raster.skew(page(degrees)) - degrees) < 0.4
    assert abs(raster.skew(raster.deskew(page(degrees)))) < 0.4


def test_skew_out_of_range_stays():
    for degrees in (0.0, 15.0):
        assert raster.deskew(page(degrees)) is not None and (raster.deskew(page(degrees)) == page(degrees)).all()
    blank = np.full((20, 20), 255, np.uint8)
    assert raster.skew(blank) == 0 and (raster.deskew(blank) == blank).all()


def test_turning_loses_nothing():
    img = page()
    assert raster.rotated_size(420, 300, 90) == (300, 420)
    assert raster.rotate_bound(img, 90).shape == (420, 300) and (raster.rotate_bound(raster.rotate_bound(img, 90), 270) == img).all()
    assert raster.rotate_bound(img, 90)[0, -1] == img[0, 0]  # clockwise: the left upper corner goes right
    turned = raster.rotate_bound(img, 30)
    assert turned.shape == (int(420 * 0.5 + 300 * np.cos(np.radians(30))), int(300 * 0.5 + 420 * np.cos(np.radians(30))))
    assert turned[0, 0] == 255 and abs(int((turned < 128).sum()) - int((img < 128).sum())) < 0.02 * (img < 128).sum()


def test_orientation_follows_the_detector_and_survives_it():
    img = page()
    assert (raster.correct_orientation(img, lambda _: 450) == raster.rotate_bound(img, 90)).all()
    assert raster.correct_orientation(img, lambda _: 360) is img

    def broken(_):
        raise RuntimeError("no text")

    assert raster.correct_orientation(img, broken) is img


def test_rules_go_and_text_stays():
    img = page()
    ruled = img.copy()
    ruled[20, 10:400] = 0
    ruled[10:290, 30] = 0
    clean = raster.remove_rulers(np.stack([ruled] * 3, axis=2))
    assert clean.shape == (300, 420, 3) and (clean[18:23, 10:60] > 200).all() and (clean[100:200, 28:33] > 200).all()
    plain = np.full((50, 60), 240, np.uint8)
    plain[10:14, 10:14] = 5
    assert raster.remove_rulers(plain) is plain


def test_resizing_and_thresholds():
    flat = np.full((30, 40), 77, np.uint8)
    assert (raster.ensure_min_dpi(flat, 150) == 77).all() and raster.ensure_min_dpi(flat, 150).shape == (64, 85)
    assert raster.ensure_min_dpi(flat, 320) is flat
    assert (raster.adaptive(flat) == 255).all()
    assert (raster.denoise(flat) == 77).all()
    for size in ((1, 1), (5, 9), (64, 64)):
        assert raster.equalize(np.full(size, 9, np.uint8)).shape == size
    noisy = np.clip(page(w=60, h=40) + np.random.default_rng(2).normal(0, 6, (40, 60)), 0, 255).astype(np.uint8)
    assert abs(raster.denoise(noisy).astype(int) - page(w=60, h=40)).mean() < abs(noisy.astype(int) - page(w=60, h=40)).mean()
    got = raster.preprocess(np.stack([page(w=120, h=80)] * 3, axis=2), 160)
    assert got.shape == (160, 240) and set(np.unique(got)) == {0, 255}
    assert set(np.unique(raster.preprocess(page(w=60, h=40), 400, aggressive=True))) <= {0, 255}


def test_tables_of_images(spark):
    flat = bytes([200] * 12)
    images = spark.createDataFrame([(1, 4, 3, flat, "x"), (1, 4, 3, flat, "x"), (2, 4, 3, None, "x"), (3, 0, 3, b"", "x"), (4, 4, 4, flat, None), (None, 4, 3, flat, "x")], "page_id long, w long, h long, pixels binary, ink string")
    assert sorted((r.page_id or 0, r.x) for r in raster.ink_profile(images).collect()) == sorted([(0, x) for x in range(4)] + [(1, x) for x in range(4)] * 2)
    assert {r.page_id: r.w for r in raster.prepare(images, 320).collect()} == {1: 4, 2: None, 3: None, 4: None, None: 4}
    assert {(r.page_id, r.level) for r in raster.levels(images).collect()} == {(1, 0), (2, None), (3, None), (4, None), (None, 0)}
    assert raster.ink_profile(images.limit(0)).count() == 0


def test_smoothing_follows_the_width(spark):
    ink = [float(i % 7) for i in range(1400)]
    rows = spark.createDataFrame([(1, i, v, 1400, 10) for i, v in enumerate(ink)] + [(2, i, v, 30, 10) for i, v in enumerate(ink[:30])], "page_id long, x long, ink double, w long, h long")
    got = {(r.page_id, r.x): r.smoothed for r in profile.smooth(rows).collect()}
    for p, n in ((1, 1400), (2, 30)):
        k = max(5, n // 200)
        want = np.convolve(ink[:n], np.ones(k) / k, mode="same")
        assert np.allclose([got[p, i] for i in range(n)], want)


@pytest.mark.parametrize("name", ["raster_column_ink", "raster_level", "raster_column_ranges"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{WHERE}/documents.parquet'")
    df = Q.QUERIES[name](spark, WHERE)
    columns = ", ".join(sorted(df.columns))
    want = sorted(con.execute(f"SELECT {columns} FROM ({Q.ORACLES[name]})").fetchall())
    assert sorted(tuple(r) for r in df.select(*sorted(df.columns)).collect()) == want and want
