"""Objective of a neighbourhood radius and time span, as column expressions (lower is better)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lambda_score(ratio: Column) -> Column:
    """Loss of plane quality: 1 without an accepted ratio, down to 0 from a ratio of 20 on."""
    return 1 - F.when(ratio >= 5, F.least(0.7 + (ratio - 5) / 50, F.lit(1.0))).otherwise(0.0)


def fixed_objective(recovery: Column, ratio: Column, angle: Column, match: Column) -> Column:
    """Weights .65 angle, .05 active planes, .25 recovery, .10 quality; .7 and .3 without focal data (null angle)."""
    loss = lambda_score(ratio)
    with_focals = 0.65 * F.least(angle / 90, F.lit(1.0)) + 0.05 * F.coalesce(1 - match, F.lit(1.0)) + 0.25 * (1 - recovery) + 0.10 * loss
    return F.when(angle.isNotNull(), with_focals).otherwise(0.7 * (1 - recovery) + 0.3 * loss)


#: Weights of angle, active planes, recovery and quality by the number of focals (up to 0, 5, 20, more). Fixed values.
ADAPTIVE_WEIGHTS = ((0, (0.0, 0.0, 0.70, 0.30)), (5, (0.35, 0.03, 0.50, 0.15)), (20, (0.50, 0.04, 0.35, 0.13)), (None, (0.65, 0.05, 0.25, 0.10)))


def adaptive_weight(n_focals: Column, which: int) -> Column:
    out = None
    for top, w in ADAPTIVE_WEIGHTS[:-1]:
        out = F.when(n_focals <= top, w[which]) if out is None else out.when(n_focals <= top, w[which])
    return out.otherwise(ADAPTIVE_WEIGHTS[-1][1][which])


def adjusted_recovery(recovery: Column, n_events: Column) -> Column:
    """Recovery against what a catalog of that size can reach, 1 at most."""
    expected = F.when(n_events < 100, 0.5 + 0.3 * (n_events / 100)).when(n_events < 500, 0.8).otherwise(0.9)
    return F.least(recovery / expected, F.lit(1.0))


def adaptive_objective(recovery: Column, ratio: Column, angle: Column, match: Column, n_focals: Column, n_events: Column) -> Column:
    """Weights by the number of focals; the angle is blended with a neutral 45 degrees while there are fewer than 20."""
    n = F.when(angle.isNull(), F.lit(0)).otherwise(F.coalesce(n_focals, F.lit(0)))
    confidence = F.least(F.sqrt(n / F.lit(20.0)), F.lit(1.0))
    angular = confidence * F.least(F.coalesce(angle, F.lit(45.0)) / 90, F.lit(1.0)) + (1 - confidence) * 0.5
    w = [adaptive_weight(n, i) for i in range(4)]
    focal = F.when(n > 0, w[0] * angular + w[1] * F.coalesce(1 - match, F.lit(1.0))).otherwise(0.0)
    return focal + w[2] * (1 - adjusted_recovery(recovery, n_events)) + w[3] * lambda_score(ratio)
