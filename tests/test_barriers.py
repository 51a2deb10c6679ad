"""Splits by levels against plain recursion."""

import math
import os

import numpy as np
import pandas as pd
import pytest

from tidemark import plans
from tidemark.operators import barriers, sea
from tidemark.plans import spatial_models

SF = "/root/testdata/sf0.1" if os.path.exists("/root/testdata/sf0.1") else "/root/testdata/sf0.001"
SITES, LAND = "region int, site long, lon double, lat double", "region int, cx bigint, cy bigint, piece int, area_km2 double"


def plain_mass(at, land, step):
    def nearest(cells):
        return min(cells, key=lambda c: (((c[0] + 0.5) * step - at[0]) ** 2 + ((c[1] + 0.5) * step - at[1]) ** 2, c[0], c[1]))

    big = [c for c in land if c[3] >= 3000]
    if big:
        c = nearest(big)
        if math.hypot(((c[0] + 0.5) * step - at[0]) * math.cos(math.radians(at[1])), (c[1] + 0.5) * step - at[1]) * 111.32 <= 200:
            return c[2]
    return nearest(land)[2] if land else None


def plain_gap(values):
    v = sorted(set(np.round(values, 3)))
    gaps = [b - a for a, b in zip(v, v[1:], strict=False)]
    if not gaps:
        return None
    i = gaps.index(max(gaps))
    return gaps[i], v[i], v[i + 1], float(np.median(gaps))


def plain_split(places, land, step, tag=""):
    """The groups of one region, lower and western sides first, with their tags."""
    cut = plain_gap([p[1] for p in places])
    if cut and cut[0] >= 1 and cut[0] >= 4 * cut[3]:
        a, b = [p for p in places if p[1] <= (cut[1] + cut[2]) / 2], [p for p in places if p[1] > (cut[1] + cut[2]) / 2]
        if min(len(a), len(b)) >= 5:
            one, two = (plain_mass(np.mean(s, axis=0), land, step) for s in (a, b))
            if one != two or not land:
                return plain_split(a, land, step, tag) + plain_split(b, land, step, tag)
    cut = plain_gap([p[0] for p in places])
    if cut and cut[0] >= 0.3:
        a, b = [p for p in places if p[0] <= (cut[1] + cut[2]) / 2], [p for p in places if p[0] > (cut[1] + cut[2]) / 2]
        if min(len(a), len(b)) >= 5:
            la, lb = [p[1] for p in a], [p[1] for p in b]
            low, high = max(min(la), min(lb)), min(max(la), max(lb))
            if high > low and (high - low) / (max(la + lb) - min(la + lb)) >= 0.3:
                held = {c[:2] for c in land}
                looked = [(math.floor((cut[1] + i * ((cut[2] - cut[1]) / 9)) / step), math.floor((low + j * ((high - low) / 19)) / step)) for i in range(10) for j in range(20)]
                if sum(c in held for c in looked) >= 0.3 * len(looked):
                    return plain_split(a, land, step, "W") + plain_split(b, land, step, "E")
    return [(places, tag)]


def plain_regions(sites, land, step):
    """{(region, site): (part, suffix)}"""
    out = {}
    for region in sorted({s[0] for s in sites}):
        own = [s for s in sites if s[0] == region]
        places = sorted({s[2:] for s in own})
        groups = plain_split(places, [c[1:] for c in land if c[0] == region], step)
        centre, width = np.mean(places, axis=0), np.ptp(places, axis=0)
        seen = {}
        for k, (part, tag) in enumerate(groups):
            dx, dy = np.mean(part, axis=0) - centre
            ns = "N" if dy > 0.15 * width[1] else "S" if dy < -0.15 * width[1] else ""
            ew = "E" if dx > 0.15 * width[0] else "W" if dx < -0.15 * width[0] else ""
            name = "" if len(groups) == 1 else tag or ns + ew or "C"
            suffix = name + (str(seen[name]) if seen.get(name) else "")
            seen[name] = seen.get(name, 0) + 1
            out.update({(region, s[1]): (k, suffix) for s in own if s[2:] in set(part)})
    return out


def as_parts(df):
    return {(r["region"], r["site"]): (r["part"], r["suffix"]) for r in df.collect()}


@pytest.mark.parametrize("seed", range(2))
def test_splits_equal_recursion(spark, seed):
    rng = np.random.default_rng(seed)
    sites, land = [], []
    for region in range(12):
        n = 0
        for cx, cy in rng.integers(-4, 5, (rng.integers(2, 6), 2)):  # clusters
            for _ in range(rng.integers(3, 12)):
                sites.append((region, n, round(float(cx * 2 + rng.random()), 2), round(float(cy * 2 + rng.random()), 2)))
                n += 1
        sites.append((region, n, *sites[-1][2:]))  # two sites at one place
        for x, y in {tuple(c) for c in rng.integers(-9, 10, (0 if region == 0 else 150, 2)).tolist()}:
            land.append((region, x, y, int((x + 9) // 3), 9000.0 if (x + y) % 3 else 900.0))
    want = plain_regions(sites, land, 1.0)
    got = as_parts(barriers.split_regions(spark.createDataFrame(sites, SITES), spark.createDataFrame(land, LAND), 1.0))
    assert got == want
    assert len({p for p, _ in want.values()}) > 2


def test_query_equals_recursion(spark):
    """The registered query, over its whole table."""
    sites = [tuple(r) for r in spatial_models._coasts(spark, SF).select("region", "site", "lon", "lat").collect()]
    land = [tuple(r) for r in sea.land_pieces(spatial_models._ridges(spark, SF), 1.0).select("region", "cx", "cy", "piece", "area_km2").collect()]
    got = as_parts(plans.QUERIES["d23_barrier_split"](spark, SF))
    assert got == plain_regions(sites, land, 1.0)
    assert {"W", "E"} <= {s for _, s in got.values()}


def test_odd_sites(spark):
    none = barriers.split_regions(spark.createDataFrame([], SITES), spark.createDataFrame([], LAND), 1.0)
    assert none.count() == 0
    odd = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, None, 0.0), (1, 3, 0.0, float("nan")), (2, 4, 5.0, 5.0)], SITES)
    assert as_parts(barriers.split_regions(odd, spark.createDataFrame([], LAND), 1.0)) == {(1, 1): (0, ""), (2, 4): (0, "")}


def test_confirmed_viable_and_refitted(spark):
    split = spark.createDataFrame([(r, i, int(i >= 5 and r < 3), "") for r in (1, 2, 3) for i in range(10)], "region int, site long, part int, suffix string")
    listed = spark.createDataFrame([(1,), (3,)], "region int")
    assert [r["region"] for r in barriers.unconfirmed(split, listed).collect()] == [2]
    plan = barriers.confirmed_plan(split, listed)
    assert {r["region"] for r in plan.collect()} == {1}
    assert {r["region"] for r in barriers.confirmed_plan(split).collect()} == {1, 2}
    # part 0: four years of five sites; part 1: three years of five sites, one of two
    seen = [("a", i, y) for y in range(4) for i in range(10) if y < 3 or i < 7] + [("b", i, y) for y in range(4) for i in range(5)]
    survey = spark.createDataFrame([(1, s, i, y) for s, i, y in seen], "region int, species string, site long, yr int")
    fit = {r["part"]: (r["fit"], r["n_sites"], r["full_years"], r["min_sites"]) for r in barriers.viability(plan, survey).collect()}
    assert fit == {0: ("OK", 5, 4, 5), 1: ("MARGINAL", 5, 3, 2)}
    more = survey.union(spark.createDataFrame([(1, "a", i, 9) for i in range(5, 10)], survey.schema))
    got = {r["species"]: (r["groups"], r["spans_multiple"]) for r in barriers.to_refit(plan, more).collect()}
    assert got == {"a": ("0,1", True), "b": ("0", False)}


def test_no_group_is_held_in_python(spark):
    sites = pd.DataFrame({"region": [1] * 12, "site": range(12), "lon": [0.0] * 12, "lat": [i / 10 if i < 6 else 10 + i / 10 for i in range(12)]})
    df = barriers.split_regions(spark.createDataFrame(sites), spark.createDataFrame([], LAND), 1.0)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in text and "CartesianProduct" not in text and {r["part"] for r in df.collect()} == {0, 1}
