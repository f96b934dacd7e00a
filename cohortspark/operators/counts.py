"""Births per combination and per model cell: everything after this reads counts, not records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.catalogue import (
    AGE_BANDS,
    ANALYSIS,
    CALENDAR,
    INSURANCE_GROUPS,
    LANDMARKS,
    MULTIPLES,
    PRETERM_WEEKS,
    SENSITIVITY_CUTOFFS,
    UNKNOWN_GROUP,
    Calendar,
    Ids,
)
from cohortspark.functions.casting import banded, grouped_code
from cohortspark.functions.exposure import definition_measures, level_order, measure_structs
from cohortspark.functions.text import array, quoted, struct
from cohortspark.operators.cdm import Cdm
from cohortspark.operators.funnel import DEFINITIONS

COVARIATES = ("age_group", "education", "state", "year")
CELL_KEYS = ("weeks", "trimester", "visits", *COVARIATES, "insurance")
FIT_KEYS = (
    "definition",
    "period",
    "cutoff",
    "measure",
    "variant",
    "stratum_variable",
    "stratum_value",
)


def _counted(
    with_exits: DataFrame, definitions: Sequence[int], keys: Mapping[str, str]
) -> DataFrame:
    """Births per definition and keys, from one aggregation of the records.

    Subjects are counted once per set of definitions they belong to, a bit mask, so no subject is
    copied per definition and the shuffle moves counts. A record of no definition has NULL keys, so
    all of them are one counted row per task and are dropped after the sum, not by a filter that
    would evaluate every cast a second time below the aggregation.
    """
    bits = {d: 1 << i for i, d in enumerate(definitions)}
    mask = " + ".join(f"if(exit_{d} IS NULL, {bit}, 0)" for d, bit in bits.items())
    values = [f"{text} AS {name}" for name, text in keys.items()]
    kept = [f"CASE WHEN mask > 0 THEN {name} END AS {name}" for name in keys]
    grouped = (
        with_exits.selectExpr(f"if(loaded, {mask}, 0) AS mask", *values)
        .selectExpr("mask", *kept)
        .groupBy("mask", *keys)
        .agg(F.expr("count(*) AS births"))
    )
    spread = array(f"if((mask & {bit}) > 0, {d}, NULL)" for d, bit in bits.items())
    return (
        grouped.selectExpr(f"explode({spread}) AS definition", *keys, "births")
        .filter("definition IS NOT NULL")
        .groupBy("definition", *keys)
        .agg(F.expr("sum(births) AS births"))
    )


_COMBINATION = {
    "weeks": "try_cast(weeks AS int)",
    "trimester": "trimester",
    "visits": "try_cast(visits AS int)",
}


def combinations(
    with_exits: DataFrame, definitions: Sequence[int] = (ANALYSIS, *LANDMARKS)
) -> DataFrame:
    """Births per definition, weeks, trimester and visits."""
    return _counted(with_exits, definitions, _COMBINATION)


def aggregated_counts(
    with_exits: DataFrame,
    definitions: Sequence[int] = tuple(d for d in DEFINITIONS if d >= ANALYSIS),
    groups: Mapping[str, str] = INSURANCE_GROUPS,
) -> DataFrame:
    """Births per definition and model cell: combinations with covariates and insurance group."""
    keys = {
        **_COMBINATION,
        "age_group": banded("age", AGE_BANDS),
        "education": "education_concept_id",
        "state": "state",
        "year": "year(delivery_date)",
        "insurance": grouped_code("insurance_code", groups, UNKNOWN_GROUP),
    }
    return _counted(with_exits, definitions, keys)


def summed(cells: DataFrame) -> DataFrame:
    """The cells summed over the covariates: births per combination."""
    return cells.groupBy("definition", "weeks", "trimester", "visits").agg(
        F.expr("sum(births) AS births")
    )


def year_births(cells: DataFrame, definition: int = ANALYSIS) -> DataFrame:
    """Births per year of delivery."""
    return (
        cells.filter(F.col("definition") == definition)
        .groupBy("year")
        .agg(F.expr("sum(births) AS births"))
    )


def last_step(attrition: DataFrame, definition: int = ANALYSIS) -> DataFrame:
    """What the last step of each year leaves."""
    return (
        attrition.filter(F.col("cohort_definition_id") == definition)
        .groupBy("source_year")
        .agg(F.expr("max_by(remaining, step) AS remaining"))
    )


def reached(combos: DataFrame, week: int) -> DataFrame:
    """The combinations of the pregnancies that reached a week."""
    return combos.filter(F.col("weeks") >= week)


def years_text(years: Sequence[int]) -> str:
    """The label of a period: its ends where it has no gap, else every year."""
    first, last = min(years), max(years)
    whole = 1 < len({*years}) == last - first + 1
    return f"{first}-{last}" if whole else ",".join(map(str, sorted({*years})))


def period_label(rows: DataFrame, year: str) -> DataFrame:
    """The same text from a column of years; the id scheme bounds how many there are."""
    return rows.agg(
        F.expr(f"array_sort(collect_set({year})) AS years")
    ).selectExpr(
        "CASE WHEN size(years) > 1 AND array_max(years) - array_min(years) + 1 = size(years) "
        "THEN concat(array_min(years), '-', array_max(years)) "
        "ELSE array_join(transform(years, y -> string(y)), ',') END AS period"
    )


@dataclass(frozen=True)
class Analysis:
    """One set of models: a definition, an outcome cut-off, a period and a kind of stratum."""

    definition: int
    measures: tuple[str, ...]
    cutoff: int = PRETERM_WEEKS
    period: str = "all"
    years: tuple[int, ...] | None = None
    stratum: str = ""


def analyses(
    period: str = "all",
    run_years: Sequence[int] = (),
    axis_years: Sequence[int] = (),
    cutoffs: Sequence[int] = SENSITIVITY_CUTOFFS,
    landmarks: Mapping[int, int] = LANDMARKS,
    strata: Sequence[str] = ("state", "insurance"),
) -> list[Analysis]:
    """The grid: main models, other cut-offs, multiples, the period axis and the strata.

    The period axis is part of it only where its years are a strict subset of the run's.
    """
    grid = [
        Analysis(definition, measures, period=period)
        for definition, measures in definition_measures(ANALYSIS, landmarks, MULTIPLES).items()
    ]
    grid += [Analysis(ANALYSIS, ("a", "c"), cutoff, period) for cutoff in cutoffs]
    if axis_years and set(axis_years) < set(run_years):
        label = years_text(axis_years)
        grid.append(Analysis(ANALYSIS, ("a", "c"), PRETERM_WEEKS, label, tuple(axis_years)))
    grid += [Analysis(ANALYSIS, ("a", "c"), PRETERM_WEEKS, period, None, s) for s in strata]
    return grid


def rated(
    cells: DataFrame,
    grid: Sequence[Analysis],
    kept: Sequence[str] = (),
    calendar: Calendar = CALENDAR,
    strict: bool = True,
) -> DataFrame:
    """Births and preterm births per analysis, measure and level, and the kept columns.

    A cell that the index refuses stops the run, unless ``strict`` is off: then it has no level.

    A cell is rated once by each measure and its preterm births are summed by every cut-off at once; analyses that
    differ in no more than the cut-off, the period or a stratum among the kept columns are told apart after the sum.
    Where no column is kept, the cells are first summed over all that no rating reads.
    """
    cutoffs = sorted({a.cutoff for a in grid})
    periods = sorted({a.years for a in grid if a.years})
    within = {years: f"_within{i}" for i, years in enumerate(periods)}
    apart = lambda a: "" if a.stratum in kept else a.stratum
    of = {}  # the definitions of each stratum, and the definitions and strata of each rating
    for analysis in grid:
        of.setdefault(apart(analysis), set()).add(analysis.definition)
    strata = [
        f"CASE WHEN definition IN ({', '.join(map(str, sorted(ids)))}) THEN "
        f"{struct(stratum_variable=quoted(name), stratum_value=name or chr(39) * 2)} END"
        for name, ids in of.items()
    ]
    rows = cells.selectExpr(
        "definition", "weeks", "trimester", "visits", *kept, "births",
        *[f"coalesce(year IN ({', '.join(map(str, years))}), false) AS {name}" for years, name in within.items()],
        f"inline({array(strata)})",
    ).filter("stratum_variable IS NOT NULL")
    common = ["definition", "stratum_variable", "stratum_value", *within.values()]
    if not kept:
        rows = rows.groupBy(*common, "weeks", "trimester", "visits").agg(F.expr("sum(births) AS births"))
    ratings = {}
    for analysis in grid:
        test = f"(definition = {analysis.definition} AND stratum_variable = {quoted(apart(analysis))})"
        for measured in measure_structs(analysis.measures, calendar, strict=strict):
            ratings.setdefault(measured, {})[test] = None
    rated_rows = [f"CASE WHEN {' OR '.join(tests)} THEN {measured} END" for measured, tests in ratings.items()]
    sums = (
        rows.selectExpr(*common, *kept, "weeks", "births", f"inline({array(rated_rows)})")
        .filter("measure IS NOT NULL")
        .groupBy(*common, "measure", "variant", "level", *kept)
        .agg(
            F.expr("sum(births) AS births"),
            *[F.expr(f"sum(if(weeks < {c}, births, 0 * births)) AS _preterm{c}") for c in cutoffs],
        )
    )
    entries = []
    for analysis in grid:
        names = ", ".join(quoted(m) for m in analysis.measures)
        test = (
            f"definition = {analysis.definition} AND stratum_variable = {quoted(apart(analysis))} "
            f"AND measure IN ({names})"
        )
        if analysis.years:
            test += f" AND {within[analysis.years]}"
        row = struct(
            period=quoted(analysis.period),
            cutoff=str(analysis.cutoff),
            stratum_variable=quoted(analysis.stratum),
            stratum_value=analysis.stratum if analysis.stratum in kept else "stratum_value",
            preterm=f"_preterm{analysis.cutoff}",
        )
        entries.append(f"CASE WHEN {test} THEN {row} END")
    keys = [*FIT_KEYS, "level", *kept]
    found = (
        sums.selectExpr(
            "definition", "measure", "variant", "level", *kept, "births", f"inline({array(entries)})"
        )
        .filter("cutoff IS NOT NULL")
        .select(*keys, "births", "preterm")
    )
    if not within or "year" in kept:
        return found
    return found.groupBy(*keys).agg(F.expr("sum(births) AS births"), F.expr("sum(preterm) AS preterm"))


def level_counts(
    cells: DataFrame, grid: Sequence[Analysis], calendar: Calendar = CALENDAR
) -> DataFrame:
    """Births and preterm births of each level of each measure, with its display position."""
    return rated(cells, grid, (), calendar).selectExpr(
        "*", f"{level_order(calendar=calendar)} AS level_order"
    )


def model_tables(cells: DataFrame, grid: Sequence[Analysis]) -> DataFrame:
    """The table of every model: births and preterm births per level and covariates."""
    return rated(cells, grid, COVARIATES)


def step_changes(attrition: DataFrame) -> DataFrame:
    """Each step beside the one before it, within its definition and year."""
    order = Window.partitionBy("cohort_definition_id", "source_year").orderBy("step")
    return attrition.withColumns(
        {
            "previous_step": F.lag("step").over(order),
            "previous_remaining": F.lag("remaining").over(order),
        }
    )


def table_rows(cdm: Cdm, records: DataFrame, ids: Ids) -> DataFrame:
    """Rows of each person-keyed table per year of the record files, zero included.

    The year of a row follows from its person id, so no table is joined to the records; the
    records only add the years that have no row anywhere.
    """
    keyed = {
        "person": "person_id",
        "observation_period": "person_id",
        "measurement": "person_id",
        "observation": "person_id",
        "fact_relationship": "fact_id_1",
    }
    year = (
        f"CAST({ids.first_year} + (id % {ids.newborn_offset}) div {ids.rows_per_year} AS int) "
        "AS source_year"
    )
    rows = records.selectExpr("source_year", "CAST(NULL AS string) AS cdm_table", "0L AS id")
    for name, column in keyed.items():
        rows = rows.unionByName(
            getattr(cdm, name)
            .selectExpr(f"{quoted(name)} AS cdm_table", f"{column} AS id")
            .selectExpr(year, "cdm_table", "id")
        )
    counts = {(name, "rows"): f"cdm_table = {quoted(name)}" for name in keyed}
    counts["person", "rows:mother"] = f"cdm_table = 'person' AND id < {ids.newborn_offset}"
    counts["person", "rows:newborn"] = f"cdm_table = 'person' AND id >= {ids.newborn_offset}"
    wide = rows.groupBy("source_year").agg(
        *[F.expr(f"count_if({test}) AS n{i}") for i, test in enumerate(counts.values())]
    )
    long = array(
        struct(cdm_table=quoted(table), rule=quoted(rule), row_count=f"n{i}")
        for i, (table, rule) in enumerate(counts)
    )
    return wide.selectExpr("source_year", f"inline({long})")


def whole_load_rows(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of the tables that are not of one year, under a NULL year."""
    result = None
    for name, table in tables.items():
        counted = table.agg(F.expr("count(*) AS row_count")).selectExpr(
            "CAST(NULL AS int) AS source_year",
            f"{quoted(name)} AS cdm_table",
            "'rows' AS rule",
            "row_count",
        )
        result = counted if result is None else result.unionByName(counted)
    return result
