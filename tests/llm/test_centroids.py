"""Centroid clustering against a plain loop."""

import hashlib
import math
import random

import numpy as np
import pytest

from masklake.llm import centroids

SCHEMA = "vec_id bigint, embedding array<float>, v string, pivots string, cluster string, distance string"


def brute(rows, clusters, rounds, dim=64):
    kept = [(i, [math.floor(64 * x) for x in np.array(e, np.float32).astype(float).tolist()]) for i, e in rows
            if e is not None and len(e) == dim and all(x is not None and math.isfinite(x) for x in e)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), np.array(r[1], np.int32).tobytes()))
    now = [v for _, v in first[:clusters]]

    def assign():
        out = []
        for i, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in now]
            out.append((i, v, d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        found = assign()
        for c in {a[2] for a in found}:
            mine = [v for _, v, k, _ in found if k == c]
            now[c] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    found = assign()
    inertia = {c: sum(d for *_, k, d in found if k == c) for c in range(len(now))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return sorted(((i, k, d, inertia[k], sum(inertia.values()), sha[k]) for i, _, k, d in found), key=repr)


@pytest.mark.parametrize("kind", ["spread", "ties", "few"])
def test_cluster(spark, kind):
    rng = random.Random(3)
    middle = [[rng.gauss(0, 2) for _ in range(64)] for _ in range(12)]
    size = {"spread": 500, "ties": 200, "few": 5}[kind]
    make = (lambda: [float(rng.choice([-1, 0, 1])) * (k < 2) for k in range(64)]) if kind == "ties" else (lambda: [m + rng.gauss(0, 0.3) for m in rng.choice(middle)])
    rows = [(k, make()) for k in range(size)]
    rows += [(7, rows[1][1]), (None, rows[2][1]), (900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 63 + [None]), (904, [1.0] * 63 + [math.nan]), (905, [1.0] * 63 + [math.inf]), (906, [1.0] * 65)]
    df = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA).repartition(5)
    found, final = centroids.cluster(df)
    got = centroids.report(found, final).collect()
    assert sorted((tuple(r)[:6] for r in got), key=repr) == brute(rows, 16, 3)
    if kind == "spread":
        assert sum(r.exact for r in got) < 0.5 * 16 * len(got)


def test_bounds_never_hide_the_nearest():
    rng = np.random.default_rng(1)
    for scale in (1, 50, 1 << 27):
        x = rng.integers(-scale, scale + 1, (300, 64)).astype(np.int32)
        now = rng.integers(-scale, scale + 1, (9, 64)).astype(np.int64)
        now[4] = now[2]
        pivots = centroids.spread_pivots(now, 3)
        table = np.sqrt(centroids._squared(x[:, None], pivots[None]).astype(float))
        cluster, best, met = centroids.nearest(x, table, now, pivots)
        every = centroids._squared(x[:, None], now[None])
        assert (cluster == every.argmin(1)).all() and (best == every.min(1)).all() and (met <= 9).all()


def test_empty_and_huge(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert centroids.report(*centroids.cluster(df)).count() == 0
    df = spark.createDataFrame([(1, [3e38] * 64, "", "", "", ""), (2, [-3e38] * 64, "", "", "", "")], SCHEMA)
    got = centroids.cluster(df)[0].collect()
    assert {r.vec_id: r.distance for r in got} == {1: 0, 2: 0} and len({r.cluster for r in got}) == 2
