"""Crude comparisons with the reference level, distributions and truncation shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions.exposure import reference_of
from cohortspark.functions.text import struct

#: The 97.5th percentile of the standard normal.
Z = 1.959963984540054

#: Two shares closer than this, relative to the larger, are equal: sums of doubles round by less.
NO_DIFFERENCE = 1e-12

GROUP = (
    "source",
    "definition",
    "period",
    "cutoff",
    "measure",
    "variant",
    "stratum_variable",
    "stratum_value",
)


def crude(counts: DataFrame, keys: tuple[str, ...] = GROUP) -> DataFrame:
    """Odds ratio, Wald limits and risk difference of each level against the reference.

    A group holds the levels of one measure, so the reference reaches its rows with a window and no
    join. An odds ratio needs four non-empty cells; a risk difference needs births on both sides, and is
    0 where the shares differ by no more than rounding.
    """
    group = Window.partitionBy(*keys)
    is_reference = F.expr(f"level = {reference_of()}")
    cells = counts.withColumns(
        {
            "reference": F.expr(reference_of()),
            "r_births": F.max(F.when(is_reference, F.col("births"))).over(group),
            "r_preterm": F.max(F.when(is_reference, F.col("preterm"))).over(group),
        }
    ).selectExpr(
        "*",
        "CAST(preterm AS double) AS _a",
        "CAST(births - preterm AS double) AS _b",
        "CAST(r_preterm AS double) AS _c",
        "CAST(r_births - r_preterm AS double) AS _d",
    )
    full = "_a > 0 AND _b > 0 AND _c > 0 AND _d > 0"
    return (
        cells.filter("level <> reference")
        .selectExpr(
            "*",
            f"CASE WHEN {full} THEN ln(_a / _b) - ln(_c / _d) END AS _log",
            f"CASE WHEN {full} THEN {Z}D * sqrt(1 / _a + 1 / _b + 1 / _c + 1 / _d) END AS _margin",
            "CASE WHEN births > 0 AND r_births > 0 THEN _a / (_a + _b) END AS _risk",
            "CASE WHEN births > 0 AND r_births > 0 THEN _c / (_c + _d) END AS _r_risk",
        )
        .selectExpr(
            "*",
            f"CASE WHEN abs(_risk - _r_risk) <= {NO_DIFFERENCE}D * greatest(_risk, _r_risk) THEN 0D "
            "ELSE _risk - _r_risk END AS risk_difference",
            "exp(_log) AS odds_ratio",
            "exp(_log - _margin) AS lower_limit",
            "exp(_log + _margin) AS upper_limit",
        )
        .selectExpr("*", "coalesce(lower_limit > 1 OR upper_limit < 1, false) AS excludes_one")
        .drop("_a", "_b", "_c", "_d", "_log", "_margin", "_risk", "_r_risk", "r_births", "r_preterm")
    )


def distribution(counts: DataFrame) -> DataFrame:
    """Births of each level per outcome: two rows per level."""
    births = (
        f"array({struct(outcome=chr(39) + 'preterm' + chr(39), n='preterm')}, "
        f"{struct(outcome=chr(39) + 'term' + chr(39), n='births - preterm')})"
    )
    kept = [c for c in counts.columns if c not in ("births", "preterm", "level_order")]
    return counts.selectExpr(*kept, f"inline({births})").withColumnRenamed("n", "births")


def truncation_share(observed: DataFrame, null_model: DataFrame) -> DataFrame:
    """The null risk difference over the observed one, level by level and scenario.

    Levels of either side are kept: each observed comparison is repeated for every scenario, and
    then fully joined with the null comparisons. Both sides are counts of levels.
    """
    scenarios = null_model.select("definition", "measure", "variant", "scenario").distinct()
    keys = ["definition", "measure", "variant", "scenario", "level"]
    seen = observed.join(scenarios, ["definition", "measure", "variant"]).selectExpr(
        *keys,
        "odds_ratio AS observed_odds_ratio",
        "lower_limit AS observed_lower",
        "upper_limit AS observed_upper",
        "excludes_one",
        "risk_difference AS observed_risk_difference",
    )
    model = null_model.selectExpr(
        *keys,
        "odds_ratio AS simulated_odds_ratio",
        "risk_difference AS simulated_risk_difference",
    )
    share = (
        "CASE WHEN excludes_one AND observed_risk_difference <> 0 "
        "THEN simulated_risk_difference / observed_risk_difference END AS share"
    )
    return seen.join(model, keys, "full").selectExpr(
        *keys,
        f"{reference_of()} AS reference",
        "observed_odds_ratio",
        "observed_lower",
        "observed_upper",
        "simulated_odds_ratio",
        "observed_risk_difference",
        "simulated_risk_difference",
        share,
    )


def largest_share_difference(shares: DataFrame, others: DataFrame) -> DataFrame:
    """Per scenario, the largest relative difference between two tables of shares."""
    keys = ["definition", "measure", "variant", "scenario", "level"]
    other = others.selectExpr(*keys, "share AS other")
    difference = "CASE WHEN other <> 0 THEN abs(share - other) / abs(other) END"
    return (
        shares.select(*keys, "share")
        .join(other, keys, "left")
        .groupBy("scenario")
        .agg(F.expr(f"max({difference}) AS largest"))
    )

