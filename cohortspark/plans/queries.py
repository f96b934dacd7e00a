"""The registered queries: each operator over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.catalogue import (
    FIELDS,
    PRETERM_WEEKS,
    SOURCE_COLUMNS,
    VOCABULARY_TARGETS,
    Calendar,
)
from cohortspark.functions import exposure
from cohortspark.functions.text import array, quoted, struct
from cohortspark.operators import (
    cdm,
    checks,
    commits,
    counts,
    epi,
    funnel,
    glm,
    load,
    nullmodel,
    publish,
    typed,
)
from cohortspark.plans import tables as t
from cohortspark.session import run_path, smaller_tasks, tuned, written
from cohortspark.sources import records as record_files
from cohortspark.sources import vocabulary
from cohortspark.sources.proxy import PROXY_SETTINGS, PROXY_YEARS, damaged, damaged_registry

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SCENARIO = ("scenario", "definition", "measure", "variant")


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _rounded(*names: str, digits: int = 6) -> list[str]:
    return [f"round({name}, {digits}) AS {name}" for name in names]


def _replaced(df: DataFrame, **changes: str) -> DataFrame:
    return df.selectExpr(*[f"{changes[c]} AS {c}" if c in changes else c for c in df.columns])


# ---------------------------------------------------------------------------------------------
# Records: casts, rules, problems


@query
def proxy_registry(spark, sf_dir):
    return t.staged(spark, sf_dir)


@query
def typed_records(spark, sf_dir):
    numbers = ["weeks", "plurality", "visits", "age", "weight"]
    concepts = [f"{n}_concept_id" for n in ("trimester", "education", "insurance", "country")]
    return t.records(spark, sf_dir).selectExpr(
        "source_year",
        "source_row",
        "person_id",
        "newborn_person_id",
        "string(delivery_date) AS delivery_date",
        "int(loaded) AS loaded",
        "year_of_birth_case",
        "year_of_birth",
        "month_of_birth",
        "day_of_birth",
        *[f"{f.name}_rule" for f in FIELDS],
        *[f"bigint({n}) AS {n}" for n in numbers],
        *concepts,
        "state",
        "newborn_gender_concept_id",
        "int(plurality_at_least) AS plurality_at_least",
    )


@query
def code_join_targets(spark, sf_dir):
    joined = typed.joined_codes(t.staged(spark, sf_dir), t.code_map(spark), FIELDS)
    rows = array(struct(field=quoted(f.name), target=f"{f.name}_target") for f in FIELDS)
    return (
        joined.selectExpr(f"inline({rows})")
        .groupBy("field", "target")
        .agg(F.expr("count(*) AS record_count"))
    )


@query
def rule_counts(spark, sf_dir):
    return typed.rule_counts(t.records(spark, sf_dir), PROXY_SETTINGS)


@query
def unloadable_top10(spark, sf_dir):
    found = typed.unloadable(t.damaged_records(spark, sf_dir), PROXY_SETTINGS)
    return typed.first_with_total(found, ["source_year", "source_row", "problem"])


@query
def unloadable_rows(spark, sf_dir):
    return typed.unloadable(t.damaged_records(spark, sf_dir), PROXY_SETTINGS)


@query
def uncountable_numbers(spark, sf_dir):
    """Visit counts that are numbers, but too large for the count columns."""
    edited = _replaced(
        t.staged(spark, sf_dir),
        totalconsultas="if(source_row % 127 = 9, concat('99999', source_row), totalconsultas)",
    )
    found = typed.uncountable(typed.typed_records(edited, PROXY_SETTINGS))
    return found.withColumnRenamed("value", "number")


# ---------------------------------------------------------------------------------------------
# Person and event tables


def _day(column: str) -> str:
    return f"string({column}) AS {column}"


@query
def location_rows(spark, sf_dir):
    return cdm.locations(t.records(spark, sf_dir)).drop("_state_source")


@query
def person_rows(spark, sf_dir):
    rows = t.records(spark, sf_dir)
    return cdm.persons(rows, cdm.locations(rows))


@query
def observation_period_rows(spark, sf_dir):
    days = ["observation_period_start_date", "observation_period_end_date"]
    rows = cdm.observation_periods(t.records(spark, sf_dir))
    return rows.selectExpr(*[_day(c) if c in days else c for c in rows.columns])


@query
def measurement_rows(spark, sf_dir):
    rows = t.records(spark, sf_dir)
    events = cdm.measurements(cdm.ranked_records(rows), cdm.loaded_total(rows))
    changes = {
        "measurement_date": _day("measurement_date"),
        "value_as_number": "bigint(value_as_number) AS value_as_number",
    }
    return events.selectExpr(*[changes.get(c, c) for c in events.columns])


@query
def observation_rows(spark, sf_dir):
    events = cdm.observations(cdm.ranked_records(t.records(spark, sf_dir)))
    changes = {
        "observation_date": _day("observation_date"),
        "value_as_number": "bigint(value_as_number) AS value_as_number",
    }
    return events.selectExpr(*[changes.get(c, c) for c in events.columns])


@query
def link_rows(spark, sf_dir):
    return cdm.links(t.records(spark, sf_dir))


@query
def cdm_source_row(spark, sf_dir):
    row = cdm.cdm_source(t.source_files(spark, sf_dir), "v1")
    return row.withColumn("source_release_date", F.expr("string(source_release_date)"))


@query
def registered_vocabularies(spark, sf_dir):
    parts = t.table(spark, sf_dir, "part")
    held = parts.groupBy(F.expr("p_brand AS vocabulary_id")).agg(
        F.expr("string(count(*)) AS vocabulary_version")
    )
    local = held.filter("vocabulary_id LIKE '%3'").unionByName(
        parts.groupBy(F.expr("concat('local ', p_type) AS vocabulary_id")).agg(
            F.expr("string(max(p_size)) AS vocabulary_version")
        )
    )
    return cdm.register_vocabularies(held, local.withColumn("vocabulary_version", F.expr(
        "concat('local ', vocabulary_version)")))


@query
def key_pivot(spark, sf_dir):
    pairs = t.table(spark, sf_dir, "customer").selectExpr("c_mktsegment AS k", "c_custkey AS v")
    return cdm.concept_pivot(pairs, "k", "v", ["AUTOMOBILE", "MACHINERY", "NONE"])


@query
def etl_counts(spark, sf_dir):
    rows, built = t.written_load(spark, sf_dir, ["*"])
    return (
        typed.rule_counts(rows, PROXY_SETTINGS)
        .unionByName(counts.table_rows(built, rows, PROXY_SETTINGS.ids))
        .unionByName(counts.whole_load_rows({"location": built.location}))
    )


# ---------------------------------------------------------------------------------------------
# Checks of a load


def _load_counts(rows: DataFrame, extra: str = "0") -> DataFrame:
    return rows.groupBy("source_year").agg(F.expr("count(*) AS n")).selectExpr(
        "source_year", "'table' AS stage", f"n + {extra} AS row_count"
    )


def _vocabularies(spark) -> DataFrame:
    return spark.createDataFrame([(v,) for v in VOCABULARY_TARGETS], "vocabulary_id string")


@query
def written_concepts(spark, sf_dir):
    """The distinct concept ids each event table holds."""
    rows, built = t.written_load(spark, sf_dir)
    return checks.distinct_concepts(vars(built)).filter("concept_id IS NOT NULL")


@query
def postload_checks(spark, sf_dir):
    rows, built = t.written_load(spark, sf_dir)
    source = cdm.cdm_source(t.source_files(spark, sf_dir), "v1")
    return checks.post_load_checks(
        built, rows, t.concepts(spark), t.code_map(spark), _vocabularies(spark),
        _load_counts(rows), source,
    )


def _doubled(df: DataFrame, test: str) -> DataFrame:
    return df.unionByName(df.filter(test))


def damage(built: cdm.Cdm) -> cdm.Cdm:
    """The event tables with every kind of violation the checks look for."""
    return cdm.Cdm(
        person=_replaced(
            built.person.filter("person_id % 211 <> 3"),
            location_id="if(location_id IS NOT NULL AND person_id % 223 = 5, 999999, location_id)",
            day_of_birth="if(person_id > 10000000000000000 AND person_id % 281 = 12, 31, day_of_birth)",
        ),
        observation_period=_doubled(
            _replaced(
                built.observation_period.filter("person_id % 229 <> 9"),
                observation_period_start_date="if(person_id % 227 = 7, "
                "date_add(observation_period_start_date, 1), observation_period_start_date)",
            ),
            "person_id % 233 = 11",
        ),
        measurement=_replaced(
            built.measurement.filter("measurement_id % 239 <> 1"),
            measurement_date="if(measurement_id % 241 = 2, date_add(measurement_date, 5), "
            "measurement_date)",
            unit_concept_id="if(measurement_id % 251 = 3, 999, unit_concept_id)",
        ),
        observation=_replaced(
            _doubled(built.observation, "observation_id % 257 = 4"),
            person_id="if(observation_id % 263 = 5, person_id + 7, person_id)",
        ),
        fact_relationship=_replaced(
            _doubled(built.fact_relationship, "fact_id_1 % 271 = 8"),
            relationship_concept_id="if(fact_id_1 % 269 = 6, 999, relationship_concept_id)",
            fact_id_2="if(fact_id_1 % 277 = 10, -1, fact_id_2)",
        ),
        location=built.location.filter("location_id % 7 <> 3"),
    )


@query
def postload_checks_damaged(spark, sf_dir):
    rows, built = t.written_load(spark, sf_dir)
    source = cdm.cdm_source(t.source_files(spark, sf_dir), "v1")
    broken = damage(built)
    return checks.post_load_checks(
        broken, rows, t.concepts(spark), t.code_map(spark),
        _vocabularies(spark).filter("vocabulary_id NOT IN ('REG_AFIL', 'REG_SEXO')"),
        _load_counts(rows, "source_year % 2"), source.unionByName(source),
        broken.observation.filter("observation_id % 1000 = 1"),
    )


@query
def gated_loads(spark, sf_dir):
    """A clean load and four that are refused, each by another gate; what is current after each."""
    target = run_path(spark, "gated")
    with smaller_tasks(tuned(spark)):
        staged = written(t.staged(spark, sf_dir), "staged")
    stages = written(_load_counts(staged), "stage_counts")
    sources = written(t.files_of(staged), "sources")
    runs = {
        "clean": (staged, stages),
        "a column less": (staged.drop("peso"), stages),
        "unloadable records": (damaged(staged), stages),
        "repeated records": (_doubled(staged, "source_row % 1000 = 7"), stages),
        "counts that differ": (staged, _replaced(stages, row_count="row_count + 1")),
    }
    rows = []
    for name, (registry, counted) in runs.items():
        try:
            with smaller_tasks(spark):
                load.gated_load(
                    registry, target, t.concepts(spark), t.code_map(spark), _vocabularies(spark), counted,
                    sources, "v1", PROXY_SETTINGS,
                )
            outcome = "promoted"
        except checks.LoadRefused as refused:
            outcome = str(refused).partition(":")[0]
        held = publish.current(spark, target, ["records"])["records"].count()
        rows.append((name, outcome, held))
    return spark.createDataFrame(rows, "run string, outcome string, records bigint")


@query
def failed_checks(spark, sf_dir):
    return checks.failed(postload_checks_damaged(spark, sf_dir))


@query
def link_differences(spark, sf_dir):
    rows = t.records(spark, sf_dir)
    links = cdm.links(rows)
    broken = _replaced(
        _doubled(links, "fact_id_1 % 271 = 8"),
        fact_id_2="if(fact_id_1 % 277 = 10, -1, fact_id_2)",
    )
    return checks.bag_difference(links, broken, checks.LINK_COLUMNS)


# ---------------------------------------------------------------------------------------------
# Cohorts


@query
def exit_steps(spark, sf_dir):
    return funnel.exit_rows(t.subjects(spark, sf_dir))


@query
def cohort_rows(spark, sf_dir):
    rows = funnel.cohort(t.subjects(spark, sf_dir))
    days = ["cohort_start_date", "cohort_end_date"]
    return rows.selectExpr(*[_day(c) if c in days else c for c in rows.columns])


@query
def attrition(spark, sf_dir):
    return funnel.attrition(t.summary(spark, sf_dir))


@query
def attrition_from_cdm(spark, sf_dir):
    """The same table from the written event tables; steps 0 and 1 from the counts of the load."""
    rows, built = t.written_load(spark, sf_dir)
    found = funnel.exits(
        funnel.criteria_from_cdm(built, None, PROXY_YEARS, PROXY_SETTINGS)
    )
    out = (
        rows.filter("NOT loaded")
        .groupBy("source_year")
        .agg(F.expr("count(*) AS n"))
        .withColumn("loaded", F.lit(False))
    )
    return funnel.attrition(
        funnel.exit_summary(found).unionByName(out, allowMissingColumns=True)
    )


def _cohort_counts(spark, sf_dir) -> DataFrame:
    return (
        funnel.exit_rows(t.subjects(spark, sf_dir))
        .filter("exit_step IS NULL")
        .groupBy("cohort_definition_id", "source_year")
        .agg(F.expr("count(*) AS n"))
    )


@query
def attrition_problems(spark, sf_dir):
    whole = attrition(spark, sf_dir)
    broken = _replaced(
        whole.filter("NOT (cohort_definition_id = 3 AND step = 5 AND source_year % 2 = 0)"),
        remaining="CASE WHEN step = 6 AND source_year % 3 = 0 THEN remaining + 5000 "
        "WHEN step = 4 AND source_year % 5 = 0 THEN -remaining ELSE remaining END",
        excluded="CASE WHEN step = 0 AND source_year % 4 = 0 THEN 1L "
        "WHEN step = 7 AND source_year % 4 = 1 THEN NULL "
        "WHEN step = 3 AND source_year % 4 = 2 THEN -excluded ELSE excluded END",
    ).filter("NOT (cohort_definition_id = 5 AND source_year % 2 = 1)")
    return checks.attrition_problems(broken, _cohort_counts(spark, sf_dir))


def _percentages(df: DataFrame) -> DataFrame:
    return df.selectExpr(
        *[f"double({c}) AS {c}" if c.endswith("_percent") else c for c in df.columns]
    )


@query
def excluded_profile(spark, sf_dir):
    return _percentages(funnel.excluded_profile(t.summary(spark, sf_dir)))


@query
def profile_problems(spark, sf_dir):
    whole = t.summary(spark, sf_dir)
    profile = _replaced(
        funnel.excluded_profile(whole).filter("NOT (cohort_definition_id = 4 AND step = 8)"),
        births="if(cohort_definition_id = 2 AND step = 5, births + 1, births)",
        step="if(cohort_definition_id = 1 AND step = 4, 6, step)",
    )
    return checks.profile_problems(profile, funnel.attrition(whole))


# ---------------------------------------------------------------------------------------------
# Exposure, counts, comparisons


@query
def exposure_levels(spark, sf_dir):
    return exposure.exposure_rows(t.subjects(spark, sf_dir)).withColumn(
        "first_trimester_start", F.expr("int(first_trimester_start)")
    )


@query
def index_variants(spark, sf_dir):
    rows = exposure.index_rows(t.analysis_combinations(spark, sf_dir)).drop("refusal")
    return rows.selectExpr(
        *[c for c in rows.columns if c != "ratio_percent"], *_rounded("ratio_percent")
    )


@query
def index_refusals(spark, sf_dir):
    """Why combinations of all loaded records, not only those of a cohort, have no index."""
    found = (
        t.subjects(spark, sf_dir)
        .filter("loaded")
        .selectExpr("int(weeks) AS weeks", "trimester", "int(visits) AS visits")
        .groupBy("weeks", "trimester", "visits")
        .agg(F.expr("count(*) AS births"))
    )
    return found.selectExpr("*", f"{exposure.index_refusal()} AS refusal").filter(
        "refusal IS NOT NULL"
    )


@query
def combinations(spark, sf_dir):
    return counts.combinations(t.subjects(spark, sf_dir))


@query
def aggregated_counts(spark, sf_dir):
    return t.cells(spark, sf_dir)


@query
def aggregated_from_cdm(spark, sf_dir):
    """The cells from the written event tables, as a run over a loaded database reads them."""
    _, built = t.written_load(spark, sf_dir)
    found = funnel.criteria_from_cdm(built, None, PROXY_YEARS, PROXY_SETTINGS)
    return counts.aggregated_counts(funnel.exits(found))


@query
def summed_cells(spark, sf_dir):
    return counts.summed(t.cells(spark, sf_dir))


@query
def landmark_counts(spark, sf_dir):
    """The analysis combinations that reached each landmark week, summed over trimesters."""
    combos = written(t.analysis_combinations(spark, sf_dir), "combinations")
    parts = [
        counts.reached(combos, week)
        .groupBy("weeks", "visits")
        .agg(F.expr("sum(births) AS births"))
        .withColumn("landmark", F.lit(week))
        for week in (28, 32, 34)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def births_per_year(spark, sf_dir):
    return counts.year_births(t.cells(spark, sf_dir))


@query
def last_steps(spark, sf_dir):
    return counts.last_step(attrition(spark, sf_dir))


@query
def births_against_attrition(spark, sf_dir):
    births = counts.year_births(t.cells(spark, sf_dir)).withColumn(
        "births", F.expr("births + year % 2")
    )
    return checks.years_not_attrition(births, last_steps(spark, sf_dir))


@query
def births_against_cohort(spark, sf_dir):
    broken = t.cells(spark, sf_dir).filter("NOT (definition = 4 AND weeks = 40)")
    return checks.births_not_cohort(broken, _cohort_counts(spark, sf_dir))


@query
def period_labels(spark, sf_dir):
    rows = t.staged(spark, sf_dir)
    whole = counts.period_label(rows, "source_year").withColumn("part", F.lit("all"))
    odd = counts.period_label(rows.filter("source_year % 2 = 1"), "source_year")
    return whole.unionByName(odd.withColumn("part", F.lit("odd")))


@query
def level_counts(spark, sf_dir):
    return counts.level_counts(t.cells(spark, sf_dir), t.GRID)


@query
def crude_odds(spark, sf_dir):
    found = epi.crude(counts.level_counts(t.cells(spark, sf_dir), t.MAIN), counts.FIT_KEYS)
    return found.selectExpr(
        *counts.FIT_KEYS, "level", "reference", "births", "preterm",
        *_rounded("odds_ratio", "lower_limit", "upper_limit", "risk_difference"),
        "int(excludes_one) AS excludes_one",
    )


@query
def exposure_distribution(spark, sf_dir):
    return epi.distribution(counts.level_counts(t.cells(spark, sf_dir), t.GRID))


@query
def stratum_counts(spark, sf_dir):
    """Births and preterm births per value of each stratum variable."""
    grid = [a for a in t.GRID if a.stratum]
    return (
        counts.level_counts(t.cells(spark, sf_dir), grid)
        .filter("measure = 'c'")
        .groupBy("stratum_variable", "stratum_value")
        .agg(F.expr("sum(births) AS births"), F.expr("sum(preterm) AS preterm"))
    )


# ---------------------------------------------------------------------------------------------
# Null model


@query
def calibration(spark, sf_dir):
    combos = written(t.analysis_combinations(spark, sf_dir), "combinations")
    found = nullmodel.calibrate(combos)
    return found.selectExpr(
        "from_week", "births", *_rounded("full_calendar_share", "visit_probability", digits=9)
    )


@query
def null_expectation(spark, sf_dir):
    combos = written(t.analysis_combinations(spark, sf_dir), "combinations")
    return nullmodel.expected(combos).selectExpr(
        "scenario", "weeks", "trimester", "visits", *_rounded("births")
    )


def _null_levels(combos: DataFrame) -> DataFrame:
    return nullmodel.level_means(nullmodel.expected(combos), PRETERM_WEEKS)


@query
def null_estimates(spark, sf_dir):
    """Crude comparisons of the null model; the births are means."""
    combos = written(t.analysis_combinations(spark, sf_dir), "combinations")
    return epi.crude(_null_levels(combos), SCENARIO).selectExpr(
        *SCENARIO, "level", "reference",
        *_rounded("births", "preterm", "odds_ratio", "lower_limit", "upper_limit"),
        *_rounded("risk_difference"),
    )


@query
def null_distribution(spark, sf_dir):
    combos = written(t.analysis_combinations(spark, sf_dir), "combinations")
    return epi.distribution(_null_levels(combos)).selectExpr(
        *SCENARIO, "level", "outcome", *_rounded("births")
    )


@query
def null_long_calendar(spark, sf_dir):
    """Births of either scenario on a calendar of 30 visits: no pregnancy is lost."""
    calendar = Calendar(first_weeks=tuple(range(8, 38)))
    combos = written(t.analysis_combinations(spark, sf_dir), "combinations")
    found = nullmodel.expected(combos, calendar, 0.8).groupBy("scenario")
    return found.agg(F.expr("round(sum(births), 3) AS births"))


@query
def null_without_effect(spark, sf_dir):
    """The built-in check: in the null world the odds ratio of (c) must not exclude 1."""
    combos = written(t.analysis_combinations(spark, sf_dir), "combinations")
    found = epi.crude(_null_levels(combos), SCENARIO).filter("measure = 'c'")
    return found.selectExpr("scenario", "level", "int(excludes_one) AS excludes_one")


def _written_cells(spark, sf_dir) -> DataFrame:
    return written(t.cells(spark, sf_dir), "cells")


def _shares(cells: DataFrame) -> DataFrame:
    main = [a for a in t.MAIN if a.cutoff == PRETERM_WEEKS and a.period == t.PERIOD]
    observed = epi.crude(
        counts.level_counts(cells.filter("definition < 6"), main), counts.FIT_KEYS
    )
    combos = counts.summed(cells.filter("definition = 2")).drop("definition")
    return epi.truncation_share(observed, epi.crude(_null_levels(combos), SCENARIO))


@query
def truncation_share(spark, sf_dir):
    return _shares(_written_cells(spark, sf_dir)).selectExpr(
        "definition", "measure", "variant", "scenario", "level", "reference",
        *_rounded(
            "observed_odds_ratio", "observed_lower", "observed_upper", "simulated_odds_ratio",
            "observed_risk_difference", "simulated_risk_difference", "share",
        ),
    )


@query
def share_difference(spark, sf_dir):
    """The exact shares against the same shares cut to two decimals."""
    shares = written(_shares(_written_cells(spark, sf_dir)), "shares")
    cut = shares.withColumn("share", F.expr("round(share, 2)"))
    return epi.largest_share_difference(cut, shares).selectExpr("scenario", *_rounded("largest"))


# ---------------------------------------------------------------------------------------------
# Adjusted models


@query
def model_tables(spark, sf_dir):
    return counts.model_tables(t.cells(spark, sf_dir), t.GRID)


@query
def covariate_references(spark, sf_dir):
    """The bases of the fits: of what is left once values of one outcome are set aside."""
    models = written(counts.model_tables(t.cells(spark, sf_dir), t.GRID), "models")
    models = glm.drop_one_outcome(models, ("level", *counts.COVARIATES))
    parts = [glm.reference_values(models, term) for term in counts.COVARIATES]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@query
def one_outcome_kept(spark, sf_dir):
    """Births each model keeps once no value of any term has births of one outcome alone."""
    models = written(counts.model_tables(t.cells(spark, sf_dir), t.GRID), "models")
    kept = glm.drop_one_outcome(models, ("level", *counts.COVARIATES))
    return kept.groupBy(*counts.FIT_KEYS, "level").agg(
        F.expr("sum(births) AS births"), F.expr("sum(preterm) AS preterm")
    )


@query
def adjusted_odds(spark, sf_dir):
    """Every adjusted model of the grid, strata included, all fitted by the same passes."""
    fitted = glm.fit_all(counts.model_tables(t.cells(spark, sf_dir), t.GRID), with_fitted=False)
    return fitted.selectExpr(
        *counts.FIT_KEYS, "level",
        *_rounded("odds_ratio", "lower_limit", "upper_limit"), "set_aside",
    )


@query
def glm_score_check(spark, sf_dir):
    """Fitted preterm births per level of the models of whole definitions.

    With every term categorical they are the observed ones.
    """
    fitted = glm.fit_all(counts.model_tables(t.cells(spark, sf_dir), t.MAIN))
    return fitted.selectExpr(*counts.FIT_KEYS, "level", *_rounded("fitted", digits=3))


@query
def score_equations(spark, sf_dir):
    """Births and fitted preterm births of every category of every term, of all models and strata.

    At the best coefficients each category's fitted births are the observed ones.
    """
    fits = glm.Fits(counts.model_tables(t.cells(spark, sf_dir), t.GRID))
    keys = fits.all_rows.select("model", *counts.FIT_KEYS).distinct()
    return fits.fitted().join(keys, "model").selectExpr(
        *counts.FIT_KEYS, "term", "value", "births", *_rounded("fitted", digits=3)
    )


@query
def births_set_aside(spark, sf_dir):
    """Births that each model's fit does not count, and those of them that it predicts exactly."""
    fits = glm.Fits(counts.model_tables(t.cells(spark, sf_dir), t.GRID))
    keys = fits.all_rows.select("model", *counts.FIT_KEYS).distinct()
    return fits.aside().join(keys, "model").drop("model")


@query
def aliased_categories(spark, sf_dir):
    """Categories whose coefficients can be traded, once a term follows from the year and one from the state."""
    models = counts.model_tables(t.cells(spark, sf_dir), t.MAIN)
    terms = ("level", *counts.COVARIATES, "era", "state_and_school")
    return glm.tradable(
        models.selectExpr(
            "*", "CASE WHEN year < 2001 THEN 'early' ELSE 'late' END AS era",
            "CASE WHEN state = '09' THEN concat('09:', education) ELSE 'elsewhere' END AS state_and_school",
        ),
        terms,
    )


@query
def crude_fits(spark, sf_dir):
    """Every model fitted without covariates: its odds ratios are the crude ones."""
    levels = counts.level_counts(t.cells(spark, sf_dir), t.GRID)
    fits = glm.Fits(levels.select(*counts.FIT_KEYS, "level", "births", "preterm"), ())
    keys = fits.all_rows.select("model", *counts.FIT_KEYS).distinct()
    odds = fits.level_odds().join(keys, "model").selectExpr(
        *counts.FIT_KEYS, "level", "odds_ratio AS level_odds"
    )
    fitted = fits.estimates(with_fitted=False).join(odds, [*counts.FIT_KEYS, "level"], "left")
    ratio = "CASE WHEN odds_ratio IS NOT NULL THEN round(level_odds, 5) END AS odds_ratio"
    limits = _rounded("lower_limit", "upper_limit", digits=5)
    return fitted.selectExpr(*counts.FIT_KEYS, "level", ratio, *limits)


@query
def estimate_keys(spark, sf_dir):
    """What the estimate rows say besides the adjusted fits."""
    return estimates(spark, sf_dir).selectExpr(
        *counts.FIT_KEYS, "level", "reference", "births", "preterm_births", "model", "source",
        "CASE WHEN model = 'crude' THEN odds_ratio END AS crude_odds_ratio",
    )


@query
def estimates(spark, sf_dir):
    """The published estimate rows: crude and adjusted, main, sensitivity, period and strata."""
    cells = written(t.cells(spark, sf_dir), "cells")
    levels = written(counts.level_counts(cells, t.GRID), "levels")
    found = glm.estimate_rows(
        levels,
        epi.crude(levels, counts.FIT_KEYS),
        glm.fit_all(counts.model_tables(cells, t.GRID), with_fitted=False),
    )
    limits = ("odds_ratio", "lower_limit", "upper_limit")
    return found.selectExpr(*[c for c in found.columns if c not in limits], *_rounded(*limits))


# ---------------------------------------------------------------------------------------------
# Code maps, concepts, keys


@query
def code_map_problems(spark, sf_dir):
    return checks.code_map_problems(
        t.part_code_map(spark, sf_dir), t.part_vocabularies(spark, sf_dir)
    )


@query
def duplicate_codes(spark, sf_dir):
    return checks.duplicate_keys(
        t.part_code_map(spark, sf_dir), ["source_vocabulary_id", "source_code"]
    )


@query
def domain_problems(spark, sf_dir):
    return checks.domain_problems(t.item_uses(spark, sf_dir), t.part_concepts(spark, sf_dir))


@query
def concept_problems(spark, sf_dir):
    expected = t.table(spark, sf_dir, "lineitem").selectExpr(
        "concat(l_orderkey, ':', l_linenumber) AS used_by",
        "CAST(l_partkey AS int) AS concept_id",
        "l_linenumber = 1 AS standard",
        "CASE WHEN l_linenumber = 2 THEN 'Unit' END AS domain_id",
        "concat('Brand#', 1 + l_partkey % 5, 1 + l_partkey % 3) AS vocabulary_id",
        "CASE WHEN l_linenumber = 3 THEN string(int(l_quantity)) END AS concept_code",
    )
    return checks.concept_problems(expected, t.part_concepts(spark, sf_dir))


@query
def lookup_problems(spark, sf_dir):
    """The codes the criteria read, against a map that repeats, drops or empties some targets."""
    codes = t.part_code_map(spark, sf_dir).withColumn(
        "target_concept_id", F.expr("try_cast(target_concept_id AS bigint)")
    )
    needed = t.table(spark, sf_dir, "part").selectExpr(
        "p_brand AS source_vocabulary_id", "string(p_partkey) AS source_code"
    )
    return checks.lookup_problems(needed, codes)


@query
def missing_keys(spark, sf_dir):
    """Customers that no order names, as keys a run needs and a table lacks."""
    needed = t.table(spark, sf_dir, "customer").selectExpr("c_custkey AS key")
    held = t.table(spark, sf_dir, "orders").selectExpr("o_custkey AS key")
    return checks.missing_keys(needed, held, "key")


@query
def vocabulary_versions(spark, sf_dir):
    rows = t.table(spark, sf_dir, "part").selectExpr(
        "CASE WHEN p_partkey <= 2 THEN 'None' ELSE p_brand END AS vocabulary_id",
        "concat('v', p_partkey) AS vocabulary_version",
    )
    return checks.vocabulary_version(rows).unionByName(
        checks.vocabulary_version(rows.filter("vocabulary_version <> 'v2'"), "v1")
    )


# ---------------------------------------------------------------------------------------------
# Files: staging, vocabulary scan, digests, publishing


#: Range cuts of written record files, and what names the year in their paths.
FILES, YEAR_OF_FILE = 24, "source_year=([0-9]+)"


def _write_csv(df: DataFrame, name: str, whole_years: bool = False) -> str:
    """The records as CSV files cut by year and record, in record order; a large year has several.

    ``whole_years`` makes one file of each year.
    """
    path = run_path(df.sparkSession, name)
    cut = df.repartition("source_year") if whole_years else df.repartitionByRange(FILES, "source_year", "source_row")
    (
        cut.sortWithinPartitions("source_year", "source_row")
        .select("source_year", *SOURCE_COLUMNS)
        .write.partitionBy("source_year")
        .options(**record_files.CSV_WRITE)
        .csv(path)
    )
    return path


def _years(df: DataFrame) -> list[int]:
    return [r[0] for r in df.select("source_year").distinct().orderBy("source_year").collect()]


def _staged_from_csv(spark, raw: DataFrame) -> DataFrame:
    path = _write_csv(raw, "csv")
    staged = record_files.stage_file(
        spark, f"{path}/*/*.csv", SOURCE_COLUMNS, run_path(spark, "staged"), group=YEAR_OF_FILE
    )
    year = F.expr(f"CAST(regexp_extract(source_file, '{YEAR_OF_FILE}', 1) AS int)")
    return staged.withColumn("source_year", year).select("source_year", "source_row", *SOURCE_COLUMNS)


@query
def staged_csv(spark, sf_dir):
    """Record files written, read back strictly, and numbered by their place in the files of their year."""
    return _staged_from_csv(spark, written(t.staged(spark, sf_dir), "raw"))


def _with_breaks(raw: DataFrame) -> DataFrame:
    """The records with quotes in some cells of all years, and line breaks in some of every third year."""
    return _replaced(
        raw,
        edad="CASE WHEN source_year % 3 = 0 AND source_row % 50 = 1 THEN concat(edad, '\n\"', source_row) "
        "WHEN source_row % 70 = 2 THEN concat('\"', edad, ',') ELSE edad END",
    )


@query
def staged_csv_with_breaks(spark, sf_dir):
    """The same of files of which some have line breaks in quoted cells."""
    return _staged_from_csv(spark, written(_with_breaks(t.staged(spark, sf_dir)), "raw"))


@query
def broken_line_files(spark, sf_dir):
    """Files and lines with an open quote at their end, by year: what decides how a file is read."""
    path = _write_csv(written(_with_breaks(t.staged(spark, sf_dir)), "raw"), "csv")
    year = F.expr(f"CAST(regexp_extract(source_file, '{YEAR_OF_FILE}', 1) AS int) AS source_year")
    return record_files.broken_lines(spark, f"{path}/*/*.csv").groupBy(year).agg(F.expr("sum(broken) AS broken"))


@query
def parquet_ordinals(spark, sf_dir):
    """The position of each row in a parquet copy of several files a year, straight from the scan."""
    path = run_path(spark, "ordinals")
    (
        t.staged(spark, sf_dir)
        .repartitionByRange(FILES, "source_year", "source_row")
        .sortWithinPartitions("source_year", "source_row")
        .selectExpr("source_year", "source_row AS record", *SOURCE_COLUMNS)
        .write.partitionBy("source_year")
        .parquet(path)
    )
    return record_files.parquet_ordinals(spark, path, YEAR_OF_FILE).select(
        "source_year", "record", "source_row", *SOURCE_COLUMNS
    )


@query
def yearly_union(spark, sf_dir):
    """One table per year, joined again with the year as a literal; two columns of the text."""
    raw = written(t.staged(spark, sf_dir), "years", ["source_year"])
    parts = {y: raw.filter(F.col("source_year") == y) for y in _years(raw)}
    return record_files.union_years(parts, ["edad", "peso"])


@query
def replaced_years(spark, sf_dir):
    """A dataset of all years whose odd years are replaced, with the others left alone."""
    raw = t.staged(spark, sf_dir).select("source_year", "source_row", "peso")
    path = run_path(spark, "replaced")
    raw.write.partitionBy("source_year").parquet(path)
    odd = raw.filter("source_year % 2 = 1 AND source_row % 10 = 0")
    record_files.replace_years(odd.withColumn("peso", F.lit("0")), path)
    return spark.read.parquet(path).groupBy("source_year").agg(
        F.expr("count(*) AS n"), F.expr("count_if(peso = '0') AS replaced")
    )


@query
def vocabulary_scan(spark, sf_dir):
    """A tab-separated vocabulary with literal quotes and dates, written and scanned."""
    path = run_path(spark, "tsv")
    (
        t.table(spark, sf_dir, "part")
        .selectExpr(
            "CAST(p_partkey AS int) AS concept_id",
            "concat('\"', p_name) AS concept_name",
            "p_type AS domain_id",
            "p_brand AS vocabulary_id",
            "CASE WHEN p_size % 2 = 0 THEN 'S' END AS standard_concept",
            "date_format(date_add(date'2020-01-01', CAST(p_partkey % 365 AS int)), 'yyyyMMdd') "
            "AS valid_start_date",
        )
        .write.options(sep="\t", quote="", header="true")
        .csv(path)
    )
    schema = (
        "concept_id int, concept_name string, domain_id string, vocabulary_id string, "
        "standard_concept string, valid_start_date date"
    )
    rows = vocabulary.read_vocabulary(spark, path, schema)
    return rows.withColumn("valid_start_date", F.expr("string(valid_start_date)"))


@query
def digest_audit(spark, sf_dir):
    """Written files against recorded digests: one changed, one of another size, one missing."""
    raw = written(t.staged(spark, sf_dir), "raw")
    path = f"{_write_csv(raw, 'csv', whole_years=True)}/*/*.csv"
    found = written(vocabulary.file_digests(spark, path, depth=2), "digests")
    recorded = found.selectExpr(
        "CASE WHEN name LIKE '%=1997/%' THEN 'gone' ELSE name END AS name",
        "CASE WHEN name LIKE '%=1996/%' THEN bytes + 1 ELSE bytes END AS bytes",
        "CASE WHEN name LIKE '%=1995/%' THEN repeat('0', 64) ELSE sha256 END AS sha256",
    )
    return (
        vocabulary.digest_problems(found, recorded)
        .groupBy("problem")
        .agg(F.expr("count(*) AS files"))
    )


@query
def stage_counts(spark, sf_dir):
    """Years whose written copy holds another number of rows than the records."""
    raw = written(t.staged(spark, sf_dir), "raw")
    return checks.count_mismatch(
        {"csv": raw, "parquet": raw.filter("source_row % 50 <> 1 OR source_year % 2 = 0")},
        "source_year",
    )


@query
def sample_compare(spark, sf_dir):
    """Every hundredth record and the last one of a year, cell by cell, against a damaged copy."""
    rows = t.staged(spark, sf_dir)
    damaged = damaged_registry(tuned(spark), sf_dir)
    return checks.sample_differences(
        rows, damaged, ["source_year", "source_row"], "source_row", 100, "source_year"
    ).withColumn("row_missing", F.expr("int(row_missing)"))


@query
def published_attrition(spark, sf_dir):
    """The attrition published as a sorted CSV and read back with its types."""
    shape = publish.OUTPUT_TABLES["attrition"]
    return publish.publish(attrition(spark, sf_dir), shape, run_path(spark, "attrition.csv"))


@query
def published_tables(spark, sf_dir):
    """All five published tables, the null scenarios among them: rows that differ from their files.

    The records are typed and judged once, and written; all five tables follow from what was written.
    """
    subjects = written(t.subjects(spark, sf_dir), "subjects")
    cells = written(counts.aggregated_counts(subjects), "cells")
    levels = written(counts.level_counts(cells, t.GRID), "levels")
    combos = written(counts.combinations(subjects, (2,)).drop("definition"), "combinations")
    summary = written(funnel.exit_summary(subjects), "summary")
    null_levels = written(_null_levels(combos), "null_levels")
    null_crude = epi.crude(null_levels, SCENARIO).withColumnRenamed("preterm", "preterm_births")
    found = glm.estimate_rows(
        levels,
        epi.crude(levels, counts.FIT_KEYS),
        glm.fit_all(counts.model_tables(cells, t.GRID), with_fitted=False),
    )
    names = {k: v.struct.names for k, v in publish.OUTPUT_TABLES.items()}

    def with_scenarios(observed, null, name, **constants):
        null = publish.scenario_rows(null, t.PERIOD, PRETERM_WEEKS).withColumns(
            {k: F.lit(v) for k, v in constants.items()}
        )
        return observed.select(names[name]).unionByName(null.select(names[name]))

    tables = {
        "attrition": funnel.attrition(summary),
        "excluded_profile": funnel.excluded_profile(summary),
        "estimates": with_scenarios(
            publish.as_published(found), null_crude, "estimates", model="crude"
        ),
        "exposure_distribution": with_scenarios(
            publish.as_published(epi.distribution(levels), source="observed"),
            epi.distribution(null_levels),
            "exposure_distribution",
        ),
        "truncation_share": publish.as_published(_shares(cells)),
    }
    parts = []
    for name, df in tables.items():
        shape = publish.OUTPUT_TABLES[name]
        table = written(publish.conform(df, shape), name)
        read = publish.publish(table, shape, run_path(spark, f"{name}.csv"))
        repeated = checks.duplicate_keys(read, shape.key).count()
        parts.append(
            publish.roundtrip_differences(table, shape, read).agg(
                F.lit(name).alias("published"),
                F.expr("coalesce(sum(copies), 0L) AS differences"),
                F.lit(repeated).cast("bigint").alias("repeated_keys"),
                F.lit(read.count() > 0).cast("int").alias("has_rows"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


@query
def published_roundtrip(spark, sf_dir):
    """Rows of a published table that differ from its file: one copy of the file is edited."""
    shape = publish.OUTPUT_TABLES["excluded_profile"]
    table = written(funnel.excluded_profile(t.summary(spark, sf_dir)), "profile")
    read = publish.publish(table, shape, run_path(spark, "profile.csv"))
    edited = _replaced(read, births="if(step = 5, births + 1, births)")
    same = publish.roundtrip_differences(table, shape, read).withColumn("file", F.lit("as written"))
    changed = publish.roundtrip_differences(table, shape, edited)
    return (
        same.unionByName(changed.withColumn("file", F.lit("edited")))
        .groupBy("file", "side")
        .agg(F.expr("sum(copies) AS copies"))
    )


@query
def publish_violations(spark, sf_dir):
    """Cells a file of estimates could not hold, from rows with nulls and infinite ratios."""
    shape = publish.OutputTable(
        "items", "order_key bigint, flag string, note string, ratio double",
        ("order_key",), ("note", "ratio"),
    )
    rows = t.table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS order_key",
        "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_returnflag END AS flag",
        "CASE WHEN l_linenumber = 6 THEN '' WHEN l_linenumber = 5 THEN NULL "
        "ELSE l_linestatus END AS note",
        "CASE WHEN l_quantity = 50 THEN double('Infinity') WHEN l_quantity = 49 "
        "THEN double('NaN') WHEN l_quantity = 48 THEN NULL ELSE l_tax END AS ratio",
    )
    return publish.violations(rows, shape)


@query
def run_manifest(spark, sf_dir):
    files = t.source_files(spark, sf_dir)
    manifest = publish.run_manifest(
        files.selectExpr("source_year AS year"),
        files.selectExpr("name AS id", "version", "sha256"),
        {"version": "v1", "sha256": "0" * 64},
        files.selectExpr("concat('copy_', name) AS name", "sha256"),
    )
    manifest = publish.write_manifest(manifest, run_path(spark, "manifest.json"))
    return manifest.selectExpr(
        "array_join(transform(period, y -> string(y)), ',') AS period",
        "array_join(transform(sources, s -> concat(s.id, '|', s.version, '|', s.sha256)), ';') "
        "AS sources",
        "vocabulary.version AS vocabulary_version",
        "array_join(transform(files, f -> concat(f.name, '|', f.sha256)), ';') AS files",
    )


@query
def promoted_load(spark, sf_dir):
    """Two loads of which the second is refused: the tables read are those of the first."""
    rows = t.records(spark, sf_dir)
    target = run_path(spark, "current")
    links = cdm.links(rows)

    def check(written_tables):
        missing = written_tables["records"].filter("delivery_date IS NULL")
        if not missing.isEmpty():
            raise checks.LoadRefused("a record has no delivery date")

    publish.load_and_promote({"records": rows, "links": links}, check, target, spark)
    broken = t.damaged_records(spark, sf_dir)
    try:
        publish.load_and_promote({"records": broken, "links": links}, check, target, spark)
    except checks.LoadRefused:
        pass
    tables = publish.current(spark, target, ["records", "links"])
    return tables["records"].groupBy("source_year").agg(
        F.expr("count(*) AS n"), F.expr("count_if(loaded) AS loaded")
    )


@query
def competing_loads(spark, sf_dir):
    """Two loads from one snapshot, of which the later is refused, one of another table, and one started afterwards.

    What each promoted, and the records that are current after it.
    """
    rows = written(t.records(spark, sf_dir).select("source_year", "source_row", "loaded"), "records")
    target = run_path(spark, "current")
    start = commits.snapshot(spark, target)
    loads = {
        "first": ({"records": rows}, start),
        "second of the same tables": ({"records": rows.filter("loaded")}, start),
        "second of other tables": ({"years": rows.select("source_year").distinct()}, start),
        "started afterwards": ({"records": rows.filter("source_year % 2 = 0")}, None),
    }
    found = []
    for name, (tables, base) in loads.items():
        try:
            publish.load_and_promote(tables, lambda stored: None, target, spark, base)
            outcome = "promoted"
        except commits.Conflict:
            outcome = "refused"
        held = commits.snapshot(spark, target)
        current = publish.current(spark, target, ["records"])["records"]
        found.append((name, outcome, held.number, len(held.entries), current.count()))
    return spark.createDataFrame(found, "run string, outcome string, number int, tables int, records bigint")


@query
def year_snapshots(spark, sf_dir):
    """Every snapshot of a dataset of years: as staged, odd years replaced, two years by two writers at once.

    A replacement that its check refuses, and one of a year that another writer has replaced, leave no snapshot.
    """
    raw = written(t.staged(spark, sf_dir).select("source_year", "source_row", "peso"), "staged")
    target = run_path(spark, "years")
    commits.replace_parts(raw, target, "source_year")
    odd = raw.filter("source_year % 2 = 1 AND source_row % 10 = 0")
    commits.replace_parts(odd.withColumn("peso", F.lit("0")), target, "source_year")

    def refuse(stored):
        if not stored.filter("peso = '1'").isEmpty():
            raise checks.LoadRefused("a weight of 1")

    start = commits.snapshot(spark, target)
    attempts = (
        (raw.withColumn("peso", F.lit("1")), refuse),
        (raw.filter("source_year = 1996 AND source_row % 5 = 0").withColumn("peso", F.lit("2")), refuse),
        (raw.filter("source_year = 1997 AND source_row % 7 = 0").withColumn("peso", F.lit("3")), refuse),
        (raw.filter("source_year = 1996").withColumn("peso", F.lit("4")), refuse),
    )
    for rows, check in attempts:
        try:
            commits.replace_parts(rows, target, "source_year", check, start)
        except checks.LoadRefused:
            continue
    found = None
    for number in range(1, commits.snapshot(spark, target).number + 1):
        part = commits.parts(spark, commits.snapshot(spark, target, number)).selectExpr(f"{number} AS snapshot", "*")
        found = part if found is None else found.unionByName(part)
    return found.groupBy("snapshot", "source_year").agg(
        F.expr("count(*) AS n"), F.expr("sum(source_row) AS rows"),
        F.expr("count_if(peso IN ('0', '1', '2', '3', '4')) AS replaced"),
    )


def _published_registry() -> publish.OutputTable:
    texts = ", ".join(f"{c} string" for c in SOURCE_COLUMNS)
    return publish.OutputTable(
        "registry", f"source_year int, source_row bigint, {texts}", ("source_year", "source_row"), tuple(SOURCE_COLUMNS)
    )


@query
def published_order(spark, sf_dir):
    """Rows out of order in two published copies of the records in many files: as published, and turned round."""
    shape = _published_registry()
    rows = written(publish.conform(t.staged(spark, sf_dir), shape), "rows")
    rows = written(rows.selectExpr(*[f"nullif({c}, '') AS {c}" if c in shape.nullable else c for c in rows.columns]), "rows")
    ascending, descending = run_path(spark, "ascending.csv"), run_path(spark, "descending.csv")
    publish.publish(rows, shape, ascending, FILES)
    turned = [F.col(k).desc() for k in shape.key]
    (
        rows.repartitionByRange(FILES, *turned).sortWithinPartitions(*turned)
        .write.options(**record_files.CSV_WRITE, nullValue="", emptyValue="").csv(descending)
    )
    parts = [
        publish.order_breaks(spark, shape, path).agg(F.sum("breaks").alias("breaks")).select(F.lit(name).alias("copy"), "breaks")
        for name, path in (("ascending", ascending), ("descending", descending))
    ]
    return parts[0].unionByName(parts[1])


@query
def registry_readback(spark, sf_dir):
    """Records that differ from their published copy, once some of it are edited, doubled or dropped."""
    shape = _published_registry()
    rows = publish.conform(t.staged(spark, sf_dir), shape)
    rows = written(rows.selectExpr(*[f"nullif({c}, '') AS {c}" if c in shape.nullable else c for c in rows.columns]), "rows")
    read = publish.publish(rows, shape, run_path(spark, "registry.csv"))
    edited = _replaced(read.filter("source_row % 3000 <> 5"), peso="if(source_row % 1000 = 1, '0', peso)")
    edited = edited.unionByName(read.filter("source_row % 2500 = 7"))
    same = publish.roundtrip_differences(rows, shape, read).withColumn("file", F.lit("as written"))
    changed = publish.roundtrip_differences(rows, shape, edited).withColumn("file", F.lit("edited"))
    return same.unionByName(changed).groupBy("file", "side", "source_year").agg(F.expr("sum(copies) AS copies"))
