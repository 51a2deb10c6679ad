"""Decision rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHA = 0.05
#: The z below which pnorm(z) is below ALPHA.
ONE_SIDED = -1.6448536269514722


def response(r: Column, d: Column, i: Column, p_r: Column, p_d: Column, p_i: Column) -> Column:
    """struct(scenario, response) from reference slope, slope deviation, intercept deviation and their P values.

    The rules are read from the top; the first that holds decides, none gives null.  They are
    evaluated inside a lambda over one struct, so each input is computed once.
    """
    row = F.struct(*[c.cast("double").alias(n) for c, n in zip((r, d, i, p_r, p_d, p_i), ("r", "d", "i", "p_r", "p_d", "p_i"), strict=True)])
    return F.element_at(F.transform(F.array(row), lambda s: _rules(s["r"], s["d"], s["i"], s["p_r"], s["p_d"], s["p_i"])), 1)


def _rules(r: Column, d: Column, i: Column, p_r: Column, p_d: Column, p_i: Column) -> Column:
    both = r + d
    sr, sd, si = p_r < ALPHA, p_d < ALPHA, p_i < ALPHA
    nr, nd, ni = p_r >= ALPHA, p_d >= ALPHA, p_i >= ALPHA
    rules = [
        ("Increasing", "Magnification", (r > 0) & (d > 0) & sd),
        ("Increasing", "Magnification", (r > 0) & sr & (i > 0) & si & nd),
        ("Increasing", "Mitigation", (r > 0) & (d < 0) & (both > 0) & sd),
        ("Increasing", "Mitigation", (r > 0) & sr & (i < 0) & si & nd),
        ("Increasing", "Opposition", (r < 0) & sr & (d > 0) & sd & (both > 0)),
        ("Matching", "Steady", ni & nd & nr),
        ("Matching", "Warming", ni & nd & sr & (r > 0)),
        ("Matching", "Cooling", ni & nd & sr & (r < 0)),
        ("Buffering", "Acceleration", (r < 0) & (d < 0) & sd),
        ("Buffering", "Acceleration", (r < 0) & sr & (i < 0) & si & nd),
        ("Buffering", "Deceleration", (r < 0) & (d > 0) & (both < 0) & sd),
        ("Buffering", "Deceleration", (r < 0) & sr & (i > 0) & si & nd),
        ("Buffering", "Annihilation", (r > 0) & sr & (d < 0) & sd & (both < 0)),
        ("Increasing", "Magnification", nr & nd & si & (i > 0)),
        ("Increasing", "Mitigation", nr & nd & si & (i < 0)),
    ]
    out = F.lit(None).cast("struct<scenario:string,response:string>")
    for scenario, name, rule in reversed(rules):
        out = F.when(rule, F.struct(F.lit(scenario).alias("scenario"), F.lit(name).alias("response"))).otherwise(out)
    return out


def trend_class(slope: Column, significant: Column) -> Column:
    return F.when(significant & (slope > 0), "Warming").when(significant & (slope < 0), "Cooling").otherwise("No trend")


def shift_class(slope: Column, significant: Column) -> Column:
    """Three classes; not significant also where nothing is known."""
    return F.when(significant & (slope > 0), "Sig_poleward").when(significant & (slope < 0), "Sig_equatorward").otherwise("NS")


def path_outcome(p_best_ref: Column, p_best_obs: Column) -> Column:
    return F.when(p_best_ref >= ALPHA, "none available").when(p_best_obs < ALPHA, "available not followed").when(p_best_ref.isNotNull(), "followed")


def path_outcome_of_tests(best_ref_z: Column, best_obs_z: Column) -> Column:
    """The same from the one-sided tests' z: P = pnorm(z) is below ALPHA where z is below ONE_SIDED."""
    p = lambda z: F.when(z < ONE_SIDED, 0.0).when(z >= ONE_SIDED, 1.0)
    return path_outcome(p(best_ref_z), p(best_obs_z))


def coverage_code(flags: dict[str, Column]) -> Column:
    """"All" where every flag holds, else the letters of those that do."""
    held = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in flags.items()]), lambda x: x.isNotNull())
    return F.when(F.size(held) == len(flags), "All").otherwise(F.array_join(held, ", "))
