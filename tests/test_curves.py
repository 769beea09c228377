"""Ridges and layers against plain loops."""

import itertools
import math

import numpy as np
import pytest

from sondage.operators import layers, ridges


def followed(f, v, img, jump):
    """The rule as loops over a matrix."""
    quality = img.max(axis=1) / (img.mean(axis=1) + 1e-30)
    start = int(np.argmax(np.round(quality, 9)))
    best = lambda row, allowed: min(allowed, key=lambda j: (-round(row[j], 9), v[j]))
    idx = {start: best(img[start], range(len(v)))}
    for step, stop in ((1, len(f)), (-1, -1)):
        prev = idx[start]
        for k in range(start + step, stop, step):
            near = [j for j in range(len(v)) if v[prev] * (1 - jump) <= v[j] <= v[prev] * (1 + jump)]
            prev = idx[k] = best(img[k], near or [prev])
    out = []
    for k, j in sorted(idx.items()):
        lo = j
        while lo > 0 and img[k][lo] > img[k][j] / 2:
            lo -= 1
        hi = j
        while hi < len(v) - 1 and img[k][hi] > img[k][j] / 2:
            hi += 1
        out.append((f[k], v[j], img[k][j], (v[hi] - v[lo]) / 2, quality[k]))
    return out


@pytest.mark.parametrize(("seed", "jump"), [(1, 0.15), (2, 0.3), (3, 0.001)])
def test_ridge_is_followed_both_ways(spark, seed, jump):
    rng = np.random.default_rng(seed)
    f, v = [5.0 + 2 * k for k in range(12)], [100.0 * 1.07**k for k in range(20)]
    shots = {}
    for shot in range(3):
        img = rng.random((12, 20)) * 0.6
        for k in range(12):
            img[k, max(0, 14 - k)] += 0.5 + 0.1 * rng.random()  # the ridge
            img[k, 18] += 0.55  # another mode
        shots[shot] = np.round(img, 2 if shot == 2 else 12)  # ties
    rows = [(s, f[i], v[j], float(img[i, j])) for s, img in shots.items() for i in range(12) for j in range(20)]
    df = spark.createDataFrame(rows, "shot long, f double, c double, energy double")
    got = sorted(map(tuple, ridges.pick_track(df, "shot", jump).collect()))
    want = sorted((s, *r) for s, img in shots.items() for r in followed(f, v, img, jump))
    assert len(got) == len(want) == 36
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b)


def test_ridge_within_bands_and_of_nothing(spark):
    df = spark.createDataFrame([(1, 5.0, 100.0, 1.0), (1, 5.0, 200.0, 3.0), (1, 7.0, 100.0, None), (1, 7.0, 200.0, 0.0)], "shot long, f double, c double, energy double")
    assert [tuple(r)[1:5] for r in ridges.pick_track(df, "shot", 0.1, velocity=(50, 150)).orderBy("f").collect()] == [(5.0, 100.0, 1.0, 0.0), (7.0, 100.0, 0.0, 0.0)]
    assert [r["f"] for r in ridges.pick_track(df, "shot", 0.1, min_quality=1.2).collect()] == [5.0]
    assert ridges.pick_track(df.limit(0), "shot").collect() == []


def plain_fit(x, t, n, least, origin=True, cuts=None):
    best = None
    for c in itertools.combinations(range(1, len(x)), n - 1) if cuts is None else [cuts]:
        edges = [0, *c, len(x)]
        if any(b - a < least for a, b in itertools.pairwise(edges)):
            continue
        ps, bs, sse = [], [], 0.0
        for k, (a, b) in enumerate(itertools.pairwise(edges)):
            if k == 0 and origin:
                p, q = float(x[a:b] @ t[a:b] / (x[a:b] @ x[a:b])), 0.0
            else:
                p, q = map(float, np.polyfit(x[a:b], t[a:b], 1))
            ps.append(p)
            bs.append(q)
            sse += float(((t[a:b] - p * x[a:b] - q) ** 2).sum())
        if min(ps) > 0 and all(b < a for a, b in itertools.pairwise(ps)) and all(q > 0 for q in bs[1:]) and (best is None or sse < best[0] - 1e-13):
            best = (sse, list(c), [1 / p for p in ps], bs[1:])
    return best


def curve(v, h, x):
    """First arrivals of head waves over horizontal layers."""
    out = []
    for k in range(len(v)):
        b = sum(2 * h[i] * math.sqrt(v[k] ** 2 - v[i] ** 2) / (v[k] * v[i]) for i in range(k))
        out.append(b + x / v[k])
    return np.min(out, axis=0)


def test_three_layers_from_noisy_picks(spark):
    rng = np.random.default_rng(7)
    x = np.arange(2.0, 60.0, 2.0)
    shots = {0: curve([350, 900, 2500], [3, 8], x), 1: curve([300, 1200, 2100], [2, 5], x) + rng.normal(0, 2e-4, len(x)), 2: curve([400, 1500], [5], x) + rng.normal(0, 1e-4, len(x)), 3: x / 500 + rng.normal(0, 3e-3, len(x)), 4: 0.05 - x * 1e-4}
    df = spark.createDataFrame([(s, float(a), float(b)) for s, t in shots.items() for a, b in zip(x, t, strict=True)] + [(0, -1.0, 1.0), (0, 5.0, None)], "shot long, x double, t double")
    for n in (1, 2, 3, 4):
        got = {r["shot"]: r for r in layers.fit_layers(df, "shot", "x", "t", n, least=3 if n == 3 else 2).collect()}
        for s, t in shots.items():
            want = plain_fit(x, t, n, 3 if n == 3 else 2)
            assert (s in got) == (want is not None), (n, s)
            if want:
                assert got[s]["sse"] == pytest.approx(want[0], abs=1e-12)
                if want[0] > 1e-10:  # else many cuts of an exact curve fit alike
                    assert got[s]["cuts"] == want[1]
                    assert got[s]["velocities"] == pytest.approx(want[2], rel=1e-6)
                    assert got[s]["intercepts"] == pytest.approx(want[3], rel=1e-5)
    three = layers.fit_layers(df.where("shot = 0"), "shot", "x", "t", 3).first()
    assert three["velocities"] == pytest.approx([350, 900, 2500], rel=1e-6) and three["thicknesses"] == pytest.approx([3, 8], rel=1e-5)


def test_crossovers_fixed_by_hand(spark):
    x = np.arange(2.0, 40.0, 2.0)
    t = curve([350, 900, 2500], [3, 8], x) + np.random.default_rng(2).normal(0, 1e-4, len(x))
    df = spark.createDataFrame([(0, float(a), float(b)) for a, b in zip(x, t, strict=True)], "shot long, x double, t double")
    at = spark.createDataFrame([(0, 1, 9.0), (0, 2, 26.0)], "shot long, k int, at double")
    got = layers.fit_layers(df, "shot", "x", "t", 3, crossovers=at).first()
    want = plain_fit(x, t, 3, 2, cuts=[4, 12])
    assert got["cuts"] == [4, 12] and got["velocities"] == pytest.approx(want[2], rel=1e-6)
    assert layers.fit_layers(df, "shot", "x", "t", 3, crossovers=at.where("k = 1")).collect() == []
    with pytest.raises(ValueError):
        layers.fit_layers(df, "shot", "x", "t", 0)
