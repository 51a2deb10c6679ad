"""Pieces across tiles, bounded distances by sea and relocation against plain versions over random seas."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.operators import relational, sea, spatial

CELLS = "region int, cx bigint, cy bigint"


def random_sea(seed, wide=14, high=10, share=0.7):
    rng = np.random.default_rng(seed)
    return {(x - wide // 2, y - high // 2) for x in range(wide) for y in range(high) if rng.random() < share}


@pytest.mark.parametrize("seed, share", [(1, 0.35), (2, 0.5), (3, 0.9)])
def test_pieces_across_tiles(spark, seed, share):
    worlds = {r: random_sea(seed * 10 + r, share=share) for r in (1, 2)}
    df = spark.createDataFrame([(r, x, y) for r, cells in worlds.items() for x, y in cells], CELLS)
    got = {(r["region"], r["cx"], r["cy"]): (r["root"]["cx"], r["root"]["cy"]) for r in sea.pieces(df, size=3).collect()}
    for region, cells in worlds.items():
        numbers = spatial.components(cells)
        for c, k in numbers.items():
            assert got[region, *c] == min(o for o in cells if numbers[o] == k)
    assert len(got) == sum(map(len, worlds.values()))


def test_distances_within_a_bound(spark):
    cells = random_sea(5, share=0.8)
    graph = spatial.neighbours(cells, 1.0)
    targets = sorted(cells)[::3]
    starts = [(c, 150.0 * (i % 4 + 1)) for i, c in enumerate(sorted(cells)[::7])]
    frame = lambda rows: spark.createDataFrame([(1, x, y) for x, y in rows], CELLS)
    s = spark.createDataFrame([(1, x, y, m) for (x, y), m in starts], "region int, sx bigint, sy bigint, most double")
    got = {((r["sx"], r["sy"]), (r["cx"], r["cy"])): r["km"] for r in sea.distances_within(s, frame(cells), frame([*targets, (50, 50)]), 1.0, size=3).collect()}
    want = {(c, t): d for c, m in starts for t, d in spatial.sea_distances(c, graph).items() if t in targets and d <= m}
    assert got == pytest.approx(want)


def plain_relocation(points, depth, samples, step, buffer_km, weight, k, lat_band):
    graph = spatial.neighbours({c for c, z in depth.items() if z < 0}, step)
    reef = sorted(c for c, z in depth.items() if z < 0 and abs(-z - 10) <= 1)
    centre = lambda c: ((c[0] + 0.5) * step, (c[1] + 0.5) * step)
    raw = {c: np.mean([1 / (d + 0.01) for d in sorted(math.hypot(centre(c)[0] - x, centre(c)[1] - y) for x, y in samples)[:k]]) for c in reef} if len(samples) >= 3 else {}
    dense = {c: (raw[c] - min(raw.values())) / (max(raw.values()) - min(raw.values()) + 1e-9) if raw else 1.0 for c in reef}
    out = {}
    for i, lon, lat in points:
        z = depth.get((math.floor(lon / step), math.floor(lat / step)))
        if z is not None and -30 <= z < 0:
            out[i] = ("ok", lon, lat, 0.0)
            continue
        if not reef:
            out[i] = ("unplaced", lon, lat, 0.0)
            continue
        start = min(graph, key=lambda c: (round((centre(c)[0] - lon) ** 2 + (centre(c)[1] - lat) ** 2, 12), c))
        far = {c: d for c, d in spatial.sea_distances(start, graph).items() if c in dense}
        far = far or {c: math.hypot((centre(c)[0] - lon) * math.cos(math.radians(lat)), centre(c)[1] - lat) * 111.32 for c in reef}
        reach = buffer_km
        while min(far.values()) > reach:
            reach *= 2
        some = {c: d for c, d in far.items() if d <= reach}
        off = {c: abs(centre(c)[1] - lat) for c in some}
        some = {c: d for c, d in some.items() if off[c] <= lat_band} or {c: d for c, d in some.items() if off[c] <= min(off.values()) + 1e-9}
        score = {c: round((1 - weight) * (1 - (d / max(some.values()) if max(some.values()) else 0)) + weight * dense[c], 12) for c, d in some.items()}
        best = min(score, key=lambda c: (-score[c], c))
        out[i] = ("to_bathy_seapath", *centre(best), some[best])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_relocation_equals_all_searches(spark, seed):
    rng = np.random.default_rng(seed)
    worlds, points, samples = {}, {}, {}
    for region in (1, 2, 3):
        water = random_sea(seed * 7 + region, share=0.55 + 0.1 * region)
        worlds[region] = {(x, y): (rng.choice([-10.0, -10.5, -200.0, -20.0], p=[0.06, 0.06, 0.8, 0.08]) if (x, y) in water else 3.0) for x in range(-7, 7) for y in range(-5, 5)}
        if region == 3 and seed == 0:
            worlds[region] = {c: -200.0 if z < 0 else z for c, z in worlds[region].items()}
        points[region] = [(int(i), float(x), float(y)) for i, (x, y) in enumerate(rng.uniform((-7.5, -5.5), (7.5, 5.5), (12, 2)).round(3))]
        samples[region] = [tuple(map(float, s)) for s in rng.uniform(-6, 6, (2 if region == 2 else 15, 2)).round(2)]
    flat = lambda held, schema: spark.createDataFrame([(r, *v) for r, rows in held.items() for v in rows], schema)
    grid = spark.createDataFrame([(r, *c, float(z)) for r, cells in worlds.items() for c, z in cells.items()], CELLS + ", z double")
    got = sea.relocated(flat(points, "region int, id bigint, lon double, lat double"), grid, flat(samples, "region int, slon double, slat double"), 1.0, k=4, lat_band=0.6, size=3)
    rows = {(r["region"], r["id"]): (r["status"], r["lon"], r["lat"], r["dist_km"]) for r in got.collect()}
    for region in worlds:
        for i, want in plain_relocation(points[region], worlds[region], samples[region], 1.0, 100.0, 0.5, 4, 0.6).items():
            assert rows[region, i][0] == want[0] and rows[region, i][1:] == pytest.approx(want[1:]), (region, i)


def test_pairs_within_a_distance_over_the_date_line_and_poles(spark):
    rng = np.random.default_rng(2)
    spots = [(float(x), float(y)) for x, y in zip(rng.uniform(-180, 180, 150), rng.uniform(-90, 90, 150))] + [(179.9, 10.0), (-179.9, 10.1), (180.0, 0.0), (-180.0, 0.0), (10.0, 89.9), (-170.0, 89.8), (0.0, -90.0)]
    p = spark.createDataFrame([(i, 1, *s) for i, s in enumerate(spots)], "point int, region int, lon double, lat double")
    s = p.select(F.col("point").alias("site"), "region", F.col("lon").alias("slon"), F.col("lat").alias("slat"))
    km = scalar.haversine_km(F.col("lon"), F.col("lat"), F.col("slon"), F.col("slat"))
    every = p.join(s, "region").withColumn("km", km)
    for most in (150.0, 2500.0, 12_000.0):
        want = {(r["point"], r["site"]) for r in every.where(F.col("km") <= most).collect()}
        found = [(r["point"], r["site"]) for r in relational.within_km(p, s, ["region"], most).collect()]
        assert set(found) == want and len(found) == len(want)
