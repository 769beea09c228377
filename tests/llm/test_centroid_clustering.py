import hashlib
import math

import numpy as np
import pytest

from sondage.llm import centroid_clustering as cc


def brute(rows, dim, scale, k, rounds, seed):
    """Plain Python integers: every distance, no bounds."""
    kept = [(i, tuple(math.floor(scale * float(v)) for v in x)) for i, x in rows if x is not None and len(x) == dim and all(v is not None and math.isfinite(v) for v in x)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [r[1] for r in order[:k]]
    d2 = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    nearest = lambda x: min(range(len(centres)), key=lambda j: (d2(x, centres[j]), j))
    for _ in range(rounds):
        of = [nearest(x) for _, x in kept]
        for j in range(len(centres)):
            own = [x for (_, x), c in zip(kept, of, strict=True) if c == j]
            if own:
                centres[j] = tuple(sum(v) // len(own) for v in zip(*own, strict=True))
    of = [nearest(x) for _, x in kept]
    dist = [d2(x, centres[c]) for (_, x), c in zip(kept, of, strict=True)]
    inertia = {c: sum(d for d, e in zip(dist, of, strict=True) if e == c) for c in of}
    return [(i, c, d, inertia[c], sum(dist), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for (i, _), c, d in zip(kept, of, dist, strict=True)]


def frame(spark, rows):
    return spark.createDataFrame([(i, x, "other") for i, x in rows], "vec_id long, embedding array<float>, cluster string")


def as_rows(df):
    return sorted(((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect()), key=str)


@pytest.mark.parametrize(("spread", "grid"), [(1.0, False), (0.05, True)])
def test_same_as_comparing_everything(spark, spread, grid):
    """Clouds, and a coarse grid where most distances are tied."""
    rng = np.random.default_rng(5)
    x = rng.normal(0, spread, (300, 6)) + rng.integers(0, 4, (300, 1)) * 3 * spread
    if grid:
        x = rng.integers(-1, 2, (300, 6)) / 8
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    out = cc.cluster(frame(spark, rows), dim=6, scale=8, k=7, rounds=4)
    assert as_rows(out) == sorted(brute(rows, 6, 8, 7, 4, 1), key=str)
    if not grid:
        assert out.agg({"n_calculated": "sum"}).first()[0] < 300 * 7 * 5 * 0.8  # bounds save work


def test_odd_rows(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [1.0]), (4, [float("nan"), 0.0]), (5, [float("inf"), 0.0]), (6, [None, 1.0]), (None, [-0.01, 0.3]), (7, [5.0, 5.0]), (8, [])]
    assert as_rows(cc.cluster(frame(spark, rows), dim=2, k=3, rounds=2)) == sorted(brute(rows, 2, 64, 3, 2, 1), key=str)
    assert as_rows(cc.cluster(frame(spark, rows), dim=2, k=16, rounds=2)) == sorted(brute(rows, 2, 64, 16, 2, 1), key=str)
    assert cc.cluster(frame(spark, []), dim=2).collect() == []
    assert cc.cluster(frame(spark, rows[2:6]), dim=2).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_calculated"]


def test_vectors_whose_distances_leave_a_long_are_not_kept(spark):
    far = [(1, [3e38, 0.0]), (2, [1e6, -1e6]), (3, [0.0, 0.0])]
    out = as_rows(cc.cluster(frame(spark, far), dim=2, k=1, rounds=1))
    assert [r[0] for r in out] == [2, 3]
    assert out == sorted(brute(far[1:], 2, 64, 1, 1, 1), key=str)


def test_bounds_hold_and_ties_go_to_the_first():
    rng = np.random.default_rng(9)
    x, centres = rng.integers(-9, 10, (500, 3)), rng.integers(-9, 10, (12, 3))
    b = cc.Bounds.unknown(x, 12)
    for _ in range(5):
        b.assign(centres)
        exact = np.stack([cc.squared(x, np.broadcast_to(c, x.shape)) for c in centres], axis=1)
        assert (b.cluster == exact.argmin(axis=1)).all()
        assert (b.lower.astype(float) <= np.sqrt(exact)).all()
        assert (b.upper.astype(float) >= np.sqrt(exact.min(axis=1))).all()
        new = centres + rng.integers(-2, 3, centres.shape)
        b.moved(cc._above(cc.squared(new, centres)) * (new != centres).any(axis=1))
        centres = new
